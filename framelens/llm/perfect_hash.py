"""A minimal perfect hash over 64-bit keys that keeps the keys, so that what isn't among them is told apart.

Each level has a bit for each of at least 1.5 times as many places as it has keys. A key that is alone at its place stays
there, the others go on to the next level. The slot of a key is the number of bits set before its own.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers for each seed."""
    x = keys ^ _U((seed * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) % 2**64)
    for shift, by in ((32, 0xD6E8FEB86659FD93), (29, 0xD6E8FEB86659FD93)):
        x = (x ^ (x >> _U(shift))) * _U(by)
    return x ^ (x >> _U(32))


class PerfectHash:
    """keys: distinct numbers, at most some millions. `keys` holds them by slot."""

    def __init__(self, keys: np.ndarray):
        rest, done = np.asarray(keys, _U), 0
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        while len(rest):
            width = max(6, int(1.5 * len(rest)).bit_length())
            place = mixed(rest, len(self.levels)) >> _U(64 - width)
            alone = np.bincount(place.astype(np.int64), minlength=1 << width)[place] == 1
            bits = np.zeros(1 << (width - 6), _U)
            np.bitwise_or.at(bits, place[alone] >> _U(6), _U(1) << (place[alone] & _U(63)))
            ones = np.bitwise_count(bits).astype(np.int64)
            self.levels.append((width, bits, done + np.cumsum(ones) - ones))
            done, rest = done + int(ones.sum()), rest[~alone]
        self.keys = np.empty(done, _U)
        self.keys[self.places(np.asarray(keys, _U))] = keys

    def __len__(self) -> int:
        return len(self.keys)

    def places(self, asked: np.ndarray) -> np.ndarray:
        """A slot for each number: the right one for a key, any or -1 for another."""
        out = np.full(len(asked), -1, np.int64)
        left = np.arange(len(asked))
        for seed, (width, bits, before) in enumerate(self.levels):
            if not len(left):
                break
            place = mixed(asked[left], seed) >> _U(64 - width)
            word, at = bits[place >> _U(6)], place & _U(63)
            hit = (word >> at) & _U(1) == 1
            below = word[hit] & ((_U(1) << at[hit]) - _U(1))
            out[left[hit]] = before[place[hit] >> _U(6)] + np.bitwise_count(below)
            left = left[~hit]
        return out

    def slots(self, asked: np.ndarray) -> np.ndarray:
        """The slot of each key, verified by the key that is stored there; -1 for any other number."""
        at = self.places(asked)
        if not len(self.keys):
            return at
        return np.where((at >= 0) & (self.keys[at] == asked), at, -1)
