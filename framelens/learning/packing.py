"""Sparse vectors as bytes. An array of (index, value) costs a reader some 30 bytes of heap an element, as many as all rows that it reads at once have;
three binary values cost what they hold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

FIELDS = ["at", "codes", "values"]
TYPE = pa.struct([(f, pa.binary()) for f in FIELDS])
SCHEMA = f"struct<{','.join(f'{f}:binary' for f in FIELDS)}>"
_SHORT = 1 << 16


def _places(size: int):
    """The least type for an index below size."""
    return np.uint16 if size <= _SHORT else np.int32


def pack(at: np.ndarray, x: np.ndarray, size: int) -> list[bytes]:
    """A vector as indexes, codes and values. Most values of a text's vector are alike: each is kept once, and its number for every index. Where more
    differ than a code can number, the values stand in order without codes."""
    values, codes = np.unique(x, return_inverse=True)
    if len(values) > _SHORT:
        return [at.astype(_places(size)).tobytes(), b"", x.tobytes()]
    return [at.astype(_places(size)).tobytes(), codes.astype(np.uint16).tobytes(), values.tobytes()]


def unpack(at, codes, values, size: int) -> tuple[np.ndarray, np.ndarray]:
    at, codes, values = np.frombuffer(at, _places(size)), np.frombuffer(codes, np.uint16), np.frombuffer(values)
    return at, values[codes] if len(codes) else values


def column(packed: list[list[bytes]]) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array([v[i] for v in packed], pa.binary()) for i in range(len(FIELDS))], fields=list(TYPE))


def is_packed(vectors: pa.Array) -> bool:
    return pa.types.is_struct(vectors.type)


def parts(vectors: pa.Array, size: int) -> list[pa.Array]:
    """FIELDS of a column of vectors, packed or not. A null is an empty vector."""
    if not is_packed(vectors):
        vectors = column([pack(*v, size) for v in each(vectors, size)])
    return [pc.fill_null(c, b"") for c in vectors.flatten()]


def each(vectors: pa.Array, size: int):
    """Indexes and values of each vector of a column, packed or not."""
    if is_packed(vectors):
        for row in zip(*parts(vectors, size), strict=True):
            yield unpack(*(c.as_buffer() for c in row), size)
    else:
        for vector in vectors:
            flat = vector.values
            yield (np.zeros(0, np.int32), np.zeros(0)) if flat is None else (flat.field(0).to_numpy(), flat.field(1).to_numpy())
