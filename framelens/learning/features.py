"""Sparse text features: windows of words and characters, counts, hashed buckets, tf-idf.

A row's features are worked out within the row, without a shuffle: windows are sorted and equal neighbours counted. The expressions are
for names and the like; `with_vectors` makes the same buckets of whole texts in batches."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelens.learning import packing


def _let(value: Column, body) -> Column:
    """body of a value that is evaluated once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def char_windows(text: Column, low: int = 3, high: int = 5) -> Column:
    """All windows of low to high characters within each word, which has a space at both ends. A word shorter than `low` is one
    window. Lower case; an empty or null text has none."""

    def of_word(w: Column) -> Column:
        sizes = [n for n in range(low, high + 1)]
        own = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(n)))
        return F.concat(*[own(n) if n == low else F.when(F.char_length(w) >= n, own(n)).otherwise(F.array().cast("array<string>")) for n in sizes])

    return F.flatten(F.transform(words(text), lambda w: _let(F.concat(F.lit(" "), w, F.lit(" ")), of_word)))


def word_tokens(text: Column) -> Column:
    """Words of at least two letters or digits, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def word_windows(text: Column) -> Column:
    """Words of at least two letters or digits, and pairs of neighbours."""
    one = word_tokens(text)
    two = lambda w: F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))).otherwise(F.array().cast("array<string>"))
    return _let(one, lambda w: F.concat(w, two(w)))


def _runs(sorted_items: Column, same, out) -> Column:
    """out(items, first, behind) of each run of equal neighbours."""

    def body(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | ~same(F.get(s, i), F.get(s, i - 1)))
        return _let(begins, lambda p: F.transform(p, lambda b, k: out(s, b, F.coalesce(F.get(p, k + 1), F.size(s)))))

    return _let(sorted_items, lambda s: F.when(F.size(s) > 0, body(s)))


def counted(windows: Column) -> Column:
    """array of (term, n), in order of the terms."""
    out = _runs(F.array_sort(windows), lambda x, y: x == y, lambda s, b, e: F.struct(F.get(s, b).alias("term"), (e - b).alias("n")))
    return F.coalesce(out, F.array().cast("array<struct<term:string,n:int>>"))


def hashed(counts: Column, buckets: int, signed: bool = False, sublinear: bool = False) -> Column:
    """array of (index, value) by ascending index, of unit length. The bucket of a term is from the first 32 bits of its md5, its sign, where
    signed, from the next; terms that share a bucket add up and may cancel out."""

    def placed(x: Column) -> Column:
        n = x["n"].cast("double")
        own = 1.0 + F.log(n) if sublinear else n
        digest = lambda m: F.struct(
            F.pmod(F.conv(F.substring(m, 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int").alias("index"),
            (F.when(F.substring(m, 9, 1) < "8", own).otherwise(-own) if signed else own).alias("value"),
        )
        return _let(F.md5(x["term"]), digest)

    total = lambda s, b, e: F.aggregate(F.slice(s, b + 1, e - b), F.lit(0.0), lambda t, x: t + x["value"])
    summed = _runs(F.array_sort(F.transform(counts, placed)), lambda x, y: x["index"] == y["index"], lambda s, b, e: F.struct(F.get(s, b)["index"].alias("index"), total(s, b, e).alias("value")))
    return unit(F.filter(F.coalesce(summed, F.array().cast("array<struct<index:int,value:double>>")), lambda x: x["value"] != 0))


def unit(vector: Column) -> Column:
    """A vector of (index, value) at length one; an empty one stays empty."""
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x["value"] * x["value"]))
    return _let(vector, lambda v: _let(length(v), lambda n: F.transform(v, lambda x: F.struct(x["index"].alias("index"), (x["value"] / n).alias("value")))))


def beside(left: Column, right: Column, size: int) -> Column:
    """Two vectors as one: the indexes of the right one follow `size` of the left."""
    return F.concat(left, F.transform(right, lambda x: F.struct((x["index"] + size).alias("index"), x["value"].alias("value"))))


#: Windows that a task remembers the buckets of, bits of a character's number in a window, and elements of vectors that are handed on at once.
KNOWN, BITS, HANDED = 1_000_000, 12, 2_000_000


def _digests(terms, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.md5(t.encode(), usedforsecurity=False).digest() for t in terms), ">u4")[::4].astype(np.int64) % size


def _summed(bucket: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sublinear counts of distinct terms, added up by bucket in order of their size, at length one."""
    own = 1.0 + np.log(n)
    order = np.lexsort((own, bucket))
    index, at = np.unique(bucket[order], return_inverse=True)
    value = np.bincount(at, own[order], len(index))
    return index, value / np.sqrt(np.cumsum(value * value)[-1:])


class _Windows:
    """Windows of 3 to `high` characters as numbers, so that they are counted without a string each, and the buckets of those seen before."""

    def __init__(self, size: int, high: int):
        self.size, self.high = size, high
        self.number, self.seen = np.zeros(0x110000, np.int64), 0
        self.of: dict[int, int] = {}

    def _numbered(self, codes: np.ndarray) -> np.ndarray | None:
        """Characters by number, from 1; None where they are more than the bits of a window hold."""
        new = np.unique(codes[self.number[codes] == 0])
        if self.seen + len(new) >= 1 << BITS:
            self.number[:], self.seen, self.of = 0, 0, {}
            new = np.unique(codes)
            if len(new) >= 1 << BITS:
                return None
        self.number[new] = self.seen + 1 + np.arange(len(new))
        self.seen += len(new)
        return self.number[codes]

    def vector(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        s = f" {' '.join(w for w in words if w)} "
        if s == "  ":
            return np.zeros(0, np.int64), np.zeros(0)
        codes = np.frombuffer(s.encode("utf-32-le"), np.uint32)
        number, gap = self._numbered(codes), codes == 32
        # within a word with a space at both ends: no space but at the ends of the window
        keys, at, sizes = [], [], []
        inner = np.zeros(len(codes), bool)
        key = None if number is None else number[:-1] | number[1:] << BITS
        for n in range(3, self.high + 1):
            inner = inner[: len(codes) - n + 1] | gap[n - 2 : len(codes) - 1]
            here = np.flatnonzero(~inner)
            if number is not None:
                key = key[: len(codes) - n + 1] | number[n - 1 :] << BITS * (n - 1)
                keys.append(key[here])
            at.append(here)
            sizes.append(np.full(len(here), n))
        at, sizes = np.concatenate(at), np.concatenate(sizes)
        if number is None:
            count = Counter(s[i : i + n] for i, n in zip(at.tolist(), sizes.tolist(), strict=True))
            return _summed(_digests(count, self.size), np.array(list(count.values()), float))
        keys, first, n = np.unique(np.concatenate(keys), return_index=True, return_counts=True)
        bucket = np.array([self.of.get(k, -1) for k in keys.tolist()], np.int64)
        new = np.flatnonzero(bucket < 0)
        if len(new):
            bucket[new] = _digests([s[i : i + m] for i, m in zip(at[first[new]].tolist(), sizes[first[new]].tolist(), strict=True)], self.size)
            self.of = self.of if len(self.of) < KNOWN else {}
            self.of.update(zip(keys[new].tolist(), bucket[new].tolist(), strict=True))
        return _summed(bucket, n.astype(float))


def _pairs_vector(tokens: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    count = Counter(tokens)
    count.update(f"{a} {b}" for a, b in zip(tokens, tokens[1:]))
    return _summed(_digests(count, size), np.array(list(count.values()), float)) if count else (np.zeros(0, np.int64), np.zeros(0))


_VECTOR = pa.struct([("index", pa.int32()), ("value", pa.float64())])


def _listed(made: list[tuple[np.ndarray, np.ndarray]]) -> pa.ListArray:
    flat = pa.StructArray.from_arrays([pa.array(np.concatenate([v[0] for v in made]).astype(np.int32)), pa.array(np.concatenate([v[1] for v in made]))], fields=list(_VECTOR))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(v[0]) for v in made]).astype(np.int32)), flat)


def with_vectors(df: DataFrame, text_col: str, size: int, high: int = 5, packed: bool = False) -> DataFrame:
    """df with `vector` in place of the text: `size` buckets of words and their pairs, then `size` of the windows of 3 to high (at most 5) characters, as
    beside(hashed(counted(word_windows)), hashed(counted(char_windows))) with sublinear counts has them. Spark splits the text. packed: as bytes, for
    models of 2 * size, not as an array."""
    if not 3 <= high <= 5:
        raise ValueError("high must lie between 3 and 5")
    text, rest = F.col(text_col), [c for c in df.columns if c != text_col]

    def run(batches):
        windows = _Windows(size, high)
        for b in batches:
            kept, made, n, first = b.select(range(len(rest))), [], 0, 0
            for i in range(b.num_rows):
                (a, x), (c, y) = _pairs_vector(b.column(len(rest))[i].as_py(), size), windows.vector(b.column(len(rest) + 1)[i].as_py())
                made.append((np.concatenate([a, c + size]), np.concatenate([x, y])))
                n += len(made[-1][0])
                if n >= HANDED or i + 1 == b.num_rows:
                    vector = packing.column([packing.pack(*v, 2 * size) for v in made]) if packed else _listed(made)
                    yield pa.RecordBatch.from_arrays([*kept.slice(first, len(made)).columns, vector], [*rest, "vector"])
                    made, n, first = [], 0, i + 1

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*rest).schema.fields)
    return df.select(*rest, word_tokens(text), F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+")).mapInArrow(run, f"{schema}, vector {packing.SCHEMA if packed else 'array<struct<index:int,value:double>>'}")


def tfidf(df: DataFrame, id_col: str, windows: Column, least: int = 1, most: int = 300_000) -> DataFrame:
    """id, term, weight: sublinear counts times ln((1 + rows) / (1 + rows with the term)) + 1, at length one in each row, over the `most` most
    frequent terms (ties by term) of at least `least` rows. Rows without such a term have none."""
    terms = df.select(F.col(id_col).alias("_id"), F.explode(counted(windows)).alias("x")).select("_id", "x.term", "x.n")
    known = terms.groupBy("term").agg(F.count("*").alias("rows"), F.sum("n").alias("total")).where(F.col("rows") >= least).orderBy(F.desc("total"), "term").limit(most)
    size = df.agg(F.count("*").alias("size"))
    known = known.join(F.broadcast(size)).select("term", (F.log((1.0 + F.col("size")) / (1.0 + F.col("rows"))) + 1.0).alias("idf"))
    # of the two sides only the vocabulary has a bound: the windows of all rows must not be broadcast, however small they are guessed to be
    raw = terms.join(F.broadcast(known), "term").select("_id", "term", ((1.0 + F.log(F.col("n").cast("double"))) * F.col("idf")).alias("w"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("_id")))
    return raw.select(F.col("_id").alias(id_col), "term", (F.col("w") / length).alias("weight"))
