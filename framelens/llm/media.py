"""Payload columns by content-defined chunking.

A payload (the text's UTF-8 bytes, padded with zeros to a positive multiple of 64) is a sequence of 8-bit
samples. A rolling gear hash over the last 32 bytes cuts it where its top bits are zero, so equal passages
give equal chunks wherever they stand. Spark joins deduplicate the chunks by digest: the smallest
(doc_id, row hash, place) owns a digest, and only owners' bytes go to the chunk store. A payload is stored
as its recipe, the ordered list of chunk digests and lengths.

Reading back takes the bytes from the store only, checks each chunk against its digest, puts payloads
together by their recipes, and computes the facts from what was read. Payloads of one chunk are known where
the chunk is read; only payloads of several chunks shuffle bytes. Recipes are deduplicated first, so a group
of copies is read once.

The stored form of a payload, whose length and digest are media_bytes and media_sha256, is its container: a
head, which is b"CDC1", the payload length and the number of chunks as little-endian 64-bit and the recipe, then the
samples. The store holds the head of a payload of one chunk beside the chunk, and that of a payload of several with
its recipe; both are taken from there, as the samples are, and a head that doesn't fit its chunks is an error.

Defined cases: a null or empty text is 64 zero bytes; rows that repeat a doc_id get a row each; an empty
table gives no rows; texts of any length are cut into chunks of at most MAX_CHUNK bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import join_small, keyed, scratch, unkeyed, written

PAD = 64
MIN_CHUNK, AVG_BITS, MAX_CHUNK = 4096, 13, 65536


def _gear() -> np.ndarray:
    """256 pseudo-random 32-bit words by the splitmix64 rule."""
    z = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def pad(data: bytes) -> bytes:
    return data + bytes(-len(data) % PAD or (0 if data else PAD))


def rolling(data: bytes) -> np.ndarray:
    """At each byte the gear hash of it and the 31 bytes before: sum of GEAR[b] << age, by doubling the window."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for w in (1, 2, 4, 8, 16):
        h[w:] += h[:-w].copy() << np.uint32(w)
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks."""
    n = len(data)
    if n <= MIN_CHUNK:
        return [n]
    at = np.flatnonzero(rolling(data) >> np.uint32(32 - AVG_BITS) == 0) + 1
    ends, start = [], 0
    while n - start > MIN_CHUNK:
        i = np.searchsorted(at, start + MIN_CHUNK)
        end = min(int(at[i]) if i < len(at) else n, start + MAX_CHUNK, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def recipe(data: bytes) -> list[tuple[bytes, int]]:
    out, start = [], 0
    for end in cuts(data):
        out.append((hashlib.sha256(data[start:end]).digest(), end - start))
        start = end
    return out


def feature(samples: np.ndarray) -> str:
    """Counts of the high nibble, the sum of squares, and the number of changes between neighbours: exact integers."""
    counts = np.bincount(samples >> 4, minlength=16)
    energy = int(np.square(samples.astype(np.uint32)).astype(np.uint64).sum())
    changes = int(np.count_nonzero(samples[1:] != samples[:-1])) if len(samples) > 1 else 0
    return "h=" + ",".join(map(str, counts.tolist())) + f";e={energy};c={changes}"


def container_head(chunks: list[tuple[bytes, int]]) -> bytes:
    """The head for a recipe, (digest, length) of each chunk in order."""
    return b"CDC1" + struct.pack("<QQ", sum(n for _, n in chunks), len(chunks)) + b"".join(d + struct.pack("<I", n) for d, n in chunks)


def facts(head: bytes, parts: list[tuple[bytes, bytes]]) -> dict:
    """head, and (digest, bytes) of a payload's chunks in order, as read back."""
    if head != container_head([(d, len(_checked(d, x))) for d, x in parts]):
        raise ValueError("a stored head does not fit its chunks")
    data = b"".join(x for _, x in parts)
    media = hashlib.sha256(head)
    media.update(data)
    return {"payload_bytes": len(data), "payload_sha256": hashlib.sha256(data).hexdigest(), "tail_crc32": zlib.crc32(data[-PAD:]), "media_bytes": len(head) + len(data),
            "media_sha256": media.hexdigest(), "feature": feature(np.frombuffer(data, np.uint8))}


FACTS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
FACT_FIELDS = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
STORE = "digest binary, head binary, data binary"
RECIPE = "_id long, _tx long, n_bytes long, media_id binary, seq int, n_chunks int, digest binary, length int, head binary"


def _recipes(batches):
    for b in batches:
        cols: list[list] = [[] for _ in range(9)]
        for i, tx, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            own = recipe(pad(raw))
            media = own[0][0] if len(own) == 1 else hashlib.sha256(b"".join(d for d, _ in own)).digest()
            head = container_head(own) if len(own) > 1 else None
            for seq, (d, n) in enumerate(own):
                for c, v in zip(cols, (i, tx, len(raw), media, seq, len(own), d, n, None if seq else head), strict=True):
                    c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary())
        names = ("_id", "_tx", "n_bytes", "media_id", "seq", "n_chunks", "digest", "length", "head")
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], list(names))


def _owned(batches):
    """(text, seqs to skip) to the other chunks, each with its head as a payload of one chunk."""
    for b in batches:
        digests, heads, data = [], [], []
        for text, skip in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            payload, start, skip = pad(text.encode("utf-8", "surrogatepass")), 0, set(skip or ())
            for seq, end in enumerate(cuts(payload)):
                if seq not in skip:
                    digests.append(hashlib.sha256(payload[start:end]).digest())
                    heads.append(container_head([(digests[-1], end - start)]))
                    data.append(payload[start:end])
                start = end
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(heads, pa.binary()), pa.array(data, pa.binary())], ["digest", "head", "data"])


def _checked(digest: bytes, data: bytes) -> bytes:
    if hashlib.sha256(data).digest() != digest:
        raise ValueError(f"chunk {digest.hex()} does not match its digest")
    return data


def _singles(batches):
    """Chunks read back, as payloads of one chunk."""
    for b in batches:
        d = b.column(0).to_pylist()
        rows = [facts(h, [(x, y)]) for x, h, y in zip(d, b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(d, pa.binary()), *[pa.array([r[k] for r in rows], t) for k, t in FACT_FIELDS]], ["media_id", *[k for k, _ in FACT_FIELDS]])


def _joined(batches):
    """(media_id, parts in order) to facts."""
    for b in batches:
        ids = b.column(0).to_pylist()
        rows = [facts(parts[0]["head"], [(p["digest"], p["data"]) for p in parts]) for parts in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), *[pa.array([r[k] for r in rows], t) for k, t in FACT_FIELDS]], ["media_id", *[k for k, _ in FACT_FIELDS]])


def store_payloads(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """Writes the chunk store. Returns the recipes (a row for each chunk of each document) and the store's path."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(keyed(id_col).alias("_id"), F.xxhash64(text).alias("_tx"), text.alias("_text"))
    recipes = written(base.mapInArrow(_recipes, RECIPE), "recipes")
    place = F.struct("_id", "_tx", "seq")
    owners = recipes.groupBy("digest").agg(F.min(place).alias("own"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = recipes.join(owners, "digest").where(place != F.col("own")).groupBy("_id", "_tx").agg(F.collect_set("seq").alias("skip"))
    copies = written(copies, "chunk-copies")
    path = scratch(spark, "chunk-store")
    # rows that repeat a document would own a chunk together: one of them is enough
    again = recipes.groupBy("_id", "_tx", "seq").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    src = base.dropDuplicates(["_id", "_tx"]) if again else base
    src = join_small(src, copies, ["_id", "_tx"], "left").select("_text", "skip")
    src.mapInArrow(_owned, STORE).write.option("compression", "zstd").parquet(path)
    return recipes, path


def read_payloads(recipes: DataFrame, path: str) -> DataFrame:
    """media_id and the facts of each distinct payload, from the chunk store under path."""
    spark = recipes.sparkSession
    store = spark.read.schema(STORE).parquet(path)
    single = recipes.where("n_chunks = 1").select(F.col("media_id").alias("digest")).distinct()
    several = recipes.where("n_chunks > 1").select("media_id", "seq", "digest", "head").distinct()
    several = written(several, "several")
    # facts of every chunk as a payload of its own are small; those that no document has are dropped by the join
    ones = store.mapInArrow(_singles, "media_id binary, " + FACTS).join(single.withColumnRenamed("digest", "media_id"), "media_id", "left_semi")
    # the bytes go once, to their payloads: the recipes come to the chunks if they are few enough
    parts = join_small(store.drop("head"), several, "digest", "inner")
    parts = parts.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("seq", "digest", "head", "data"))).alias("parts"))
    return ones.unionByName(parts.mapInArrow(_joined, "media_id binary, " + FACTS))


def payload_facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the facts of every row's payload, after a round trip through the chunk store."""
    recipes, path = store_payloads(docs, id_col, text_col)
    found = written(read_payloads(recipes, path), "payload-facts")
    one = recipes.where("seq = 0").select("_id", "n_bytes", "media_id", "n_chunks")
    return one.join(found, "media_id").select(unkeyed("_id").alias(id_col), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.col("n_chunks").cast("long").alias("n_chunks"))
