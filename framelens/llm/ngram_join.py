"""Near-duplicate join on word 5-grams: a MinHash LSH forest, then exact verification.

A document's set is that of its 5-word windows (words: lower case, split at white space; a text of fewer
words is one window), each as a 64-bit hash. Documents with the same word sequence form one text; only a
text's first document goes on, with the number of its copies.

Forest: TREES trees, each a sorted run of the labels of DEPTH MinHash values, dealt out by ranges, so the
texts that share a prefix stand together, also a very large group, over as many partitions as it needs.
A run gives each text the smallest id of its group at every prefix length between LEAST and DEPTH; groups
that go over the end of a partition are joined by bridges. Prefixes start at DEPTH in every tree and are
shortened, one tree at a time, each time in the tree where that adds the fewest grouped texts, until two
sets of similarity THRESHOLD share a prefix in some tree with probability RECALL or more.

Texts connected by groups are a candidate component. A component of more than BLOCK texts is cut into blocks,
texts of the same groups side by side, and two blocks are compared only where some group has texts of both; within
blocks that are compared every pair is verified exactly. A task takes a pair of blocks at a time, so a large
component is many tasks; only links per text and a spanning set of links leave a block pair, never all pairs.
Results are whole: no cap on groups, candidates or partners.

A text is named by a 64-bit hash of its words' 128-bit digest; texts that share a name get others until none do.

Defined cases: null and empty texts have no words and are copies of each other, linked to nothing else; a
null id is smaller than any other; rows that repeat an id are one document if their words are the same, else
they are separate rows under one id; an empty table gives no rows.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import join_small, keyed, unkeyed, written
from framelens.llm.graph import components

WORDS, THRESHOLD, RECALL = 5, Fraction(4, 5), 0.9999
TREES, DEPTH, LEAST = 24, 6, 4
BLOCK = 256
SEED = 0x9E3779B97F4A7C15


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    z = (_mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(SEED)) >> np.uint64(32)).astype(np.uint32)
    return z[:n] | np.uint32(1), z[n:]


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash for each word, from prefix sums of a polynomial over the bytes."""
    raw = np.frombuffer(" ".join(text.lower().split()).encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.array([], np.uint64)
    n = len(raw)
    powers = np.full(n, _ODD, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * powers, dtype=np.uint64)])
    gap = np.flatnonzero(raw == 32)
    start, end = np.concatenate([[0], gap + 1]), np.concatenate([gap, [n]])
    back = np.full(n, _INVERSE, np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    return _mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))


def shingles(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the n-word windows."""
    if not len(words):
        return words
    k = min(n, len(words))
    h = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        h = (h + words[j : len(words) - k + 1 + j]) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
    return np.unique(_mix(h))


def text_key(words: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()


def signature(own: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest value of the set, as 32-bit hashes, under each of the maps x -> (x ^ b) * a."""
    own = (own >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(own), 1024):
        part = own[at : at + 1024]
        np.minimum(out, ((part[None, :] ^ b[:, None]) * a[:, None]).min(axis=1), out=out)
    return out


def _texts(trees: int, depth: int):
    def run(batches):
        a, b = _multipliers(trees * depth)
        for batch in batches:
            keys, sizes, sigs = [], [], []
            for text in batch.column(1).to_pylist():
                w = word_hashes(text or "")
                own = shingles(w)
                keys.append(text_key(w))
                sizes.append(len(own))
                sigs.append(signature(own, a, b).astype(">u4").tobytes() if len(own) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary())], ["_id", "_tx", "_key", "_size", "_sig"])

    return run


def _runs(depth: int, least: int):
    """Sorted (tree, label, id) of one partition to (tree, id, prefix, root at each length from least to depth).
    The first and the last row of each tree in the partition are kept whatever they share: a group may go on
    in the partition beside. Rows that share a prefix of no length with a neighbour are dropped."""
    widths = range(least, depth + 1)

    def run(batches):
        roots: list[int] = [0] * len(widths)
        prev = None  # (tree, label, roots, emitted)

        cols: list[list] = [[], [], [], [], []]

        def put(tree, label, i, r, edge):
            for c, v in zip(cols, (tree, label, i, list(r), edge), strict=True):
                c.append(v)

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.list_(pa.int64())), pa.array(cols[4], pa.bool_())], ["tree", "label", "id", "roots", "edge"])
            for c in cols:
                c.clear()
            return out

        for b in batches:
            for tree, label, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if prev is None or prev[0] != tree:
                    if prev is not None and prev[4] != "edge":
                        put(prev[0], prev[1], prev[2], prev[3], True)
                    roots, first, shared = [i] * len(widths), True, False
                else:
                    first = False
                    shared = label[: 4 * least] == prev[1][: 4 * least]
                    if shared and not prev[4]:
                        put(prev[0], prev[1], prev[2], prev[3], False)
                    roots = [r if label[: 4 * w] == prev[1][: 4 * w] else i for w, r in zip(widths, prev[3], strict=True)]
                if first or shared:
                    put(tree, label, i, roots, first)
                prev = (tree, label, i, roots, "edge" if first else "in" if shared else "")
                if len(cols[0]) >= 20_000:
                    yield flush()
        if prev is not None and prev[4] != "edge":
            put(prev[0], prev[1], prev[2], prev[3], True)
        yield flush()

    return run


def recall_at(depths: dict[int, int], s: float) -> float:
    miss = 1.0
    for d in depths.values():
        miss *= 1 - s**d
    return 1 - miss


def shorten(grouped: dict[tuple[int, int], int], trees: int, depth: int, least: int, s: float, recall: float) -> dict[int, int]:
    """Prefix length by tree. grouped: texts that share a prefix with another, by (tree, length)."""
    depths = dict.fromkeys(range(trees), depth)
    while recall_at(depths, s) < recall:
        can = [t for t, d in depths.items() if d > least]
        if not can:
            raise ValueError(f"{trees} trees of prefixes of {least} reach a recall of {recall_at(depths, s):.6f} only")
        t = min(can, key=lambda t: (grouped.get((t, depths[t] - 1), 0) - grouped.get((t, depths[t]), 0), -depths[t], t))
        depths[t] -= 1
    return depths


def _verify(limit: Fraction):
    """Sorted (comp, i, j, id, side, copies, own) rows, a pair of blocks after another, to (id, root, links, texts)."""
    top, below = limit.numerator, limit.denominator

    def compare(rows):
        ids = np.array([r[0] for r in rows], np.int64)
        side = np.array([r[1] for r in rows])
        copies = np.array([r[2] for r in rows], np.int64)
        sizes = np.array([len(r[3]) for r in rows], np.int64)
        every = np.concatenate([r[3] for r in rows])
        owner = np.repeat(np.arange(len(rows)), sizes)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        fresh = np.concatenate([[True], every[1:] != every[:-1]])
        number = np.cumsum(fresh) - 1
        count = np.bincount(number)
        kept = count[number] > 1  # windows of one text add to no intersection
        number, owner = number[kept], owner[kept]
        inter = np.zeros((len(rows), len(rows)), np.float32)
        if len(number):
            _, number = np.unique(number, return_inverse=True)
            width = max(1, 4_000_000 // len(rows))
            for at in range(0, int(number[-1]) + 1, width):
                lo, hi = np.searchsorted(number, [at, at + width])
                m = np.zeros((len(rows), min(width, int(number[-1]) + 1 - at)), np.float32)
                m[owner[lo:hi], number[lo:hi] - at] = 1
                inter += m @ m.T
        inter = inter.astype(np.int64)
        union = sizes[:, None] + sizes[None, :] - inter
        link = below * inter >= top * union
        np.fill_diagonal(link, False)
        if side.any():
            link &= side[:, None] != side[None, :]  # pairs within a block are another task's
        texts = link.sum(axis=1)
        links = link @ copies
        # one link for each text to the smallest id of its part of the block pair
        root = np.arange(len(rows))
        while True:
            low = np.minimum(root, np.where(link, root[None, :], len(rows)).min(axis=1))
            low = np.minimum(low, low[low])
            if (low == root).all():
                break
            root = low
        has = np.flatnonzero(texts)
        return ids[has], ids[root[has]], links[has], texts[has]

    def run(batches):
        held, key = [], None
        for b in batches:
            k = list(zip(*(b.column(c).to_pylist() for c in range(3)), strict=True))
            ids, side, copies = (b.column(c).to_pylist() for c in (3, 4, 5))
            offsets, values = b.column(6).offsets.to_numpy(), b.column(6).values.to_numpy().view(np.uint64)
            out = []
            for r, own in enumerate(k):
                if own != key:
                    if len(held) > 1:
                        out.append(compare(held))
                    held, key = [], own
                held.append((ids[r], side[r], copies[r], values[offsets[r] : offsets[r + 1]].copy()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["id", "root", "links", "texts"])
        if len(held) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in compare(held)], ["id", "root", "links", "texts"])

    return run


def _named(texts: DataFrame) -> DataFrame:
    """texts with an id of their own for each _key."""
    texts = written(texts.withColumn("id", F.xxhash64("_key")), "ngram-texts")
    for turn in range(1, 20):
        twice = written(texts.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(True).alias("_twice")), "ngram-twice")
        if twice.isEmpty():
            return texts
        again = F.when(F.col("_twice"), F.xxhash64("_key", F.lit(turn))).otherwise(F.col("id"))
        texts = written(join_small(texts, twice, "id", "left").withColumn("id", again).drop("_twice"), "ngram-texts")
    raise RuntimeError("texts still share names")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: Fraction = THRESHOLD, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """A row for each row of docs: id, class_id (the smallest id that it is connected to by links), n_links
    (other rows at threshold or above, copies among them), n_texts (different texts among these), n_copies, and
    text_hash (row_hash of the text) and is_first: of each class the rows of one id and text_hash, the smallest."""
    base = docs.select(keyed(id_col).alias("_id"), F.col(text_col).alias("_text"))
    hashed = base.select("_id", "_text", row_hash(F.col("_text")).alias("_tx"))
    rows = written(hashed.mapInArrow(_texts(trees, depth), "_id long, _tx long, _key binary, _size int, _sig binary"), "ngram-rows")
    # a text is known by its smallest id and, as an id may repeat, by a number of its own
    texts = rows.groupBy("_key").agg(F.min("_id").alias("first"), F.min(F.struct("_id", "_tx")).alias("first_row"), F.count("*").alias("copies"), F.first("_size").alias("size"), F.first("_sig").alias("sig"))
    texts = _named(texts)

    label = lambda t: F.substring("sig", 4 * depth * t + 1, 4 * depth)
    forest = texts.where("size > 0").select("id", F.posexplode(F.array(*[label(t) for t in range(trees)])).alias("tree", "label"))
    runs = forest.select(F.col("tree").cast("int"), "label", "id").repartitionByRange("tree", "label", "id").sortWithinPartitions("tree", "label", "id")
    runs = written(runs.mapInArrow(_runs(depth, least), "tree int, label binary, id long, roots array<long>, edge boolean"), "ngram-runs")
    ways = range(least, depth + 1)
    at = F.explode(F.array(*[F.struct(F.lit(w).alias("width"), F.substring("label", 1, 4 * w).alias("prefix"), F.element_at("roots", w - least + 1).alias("root")) for w in ways]))
    levels = runs.select("tree", "id", at.alias("x")).select("tree", "id", "x.*")
    grouped = {(r["tree"], r["width"]): r["n"] for r in levels.where("id <> root").groupBy("tree", "width").agg(F.count("*").alias("n")).collect()}
    depths = shorten(grouped, trees, depth, least, float(threshold), recall)
    chosen = F.create_map(*[F.lit(x) for td in depths.items() for x in td])
    inside = runs.select("id", F.element_at("roots", chosen[F.col("tree")] - least + 1).alias("root")).where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))
    ends = runs.where("edge").select("tree", F.substring("label", F.lit(1), 4 * chosen[F.col("tree")]).alias("prefix"), F.element_at("roots", chosen[F.col("tree")] - least + 1).alias("root"))
    low = ends.groupBy("tree", "prefix").agg(F.min("root").alias("low"))
    bridges = ends.join(low, ["tree", "prefix"]).where("root <> low").select(F.col("root").alias("a"), F.col("low").alias("b"))
    found = components(inside.unionByName(bridges), "ngram-candidates")

    # roots have no row of their own in `found`
    sizes = found.groupBy(F.col("root").alias("comp")).agg((F.count("*") + 1).alias("n"))
    members = found.select("id", F.col("root").alias("comp")).join(sizes, "comp").unionByName(sizes.select("comp", F.col("comp").alias("id"), "n"))
    root = F.element_at("roots", chosen[F.col("tree")] - least + 1)
    near = runs.groupBy("id").agg(F.min(root).alias("near"))
    members = members.join(texts.select("id", "first", "copies", "_key"), "id").join(near, "id", "left")
    members = members.repartitionByRange("comp", "near", "id").sortWithinPartitions("comp", "near", "id")
    # the place of a row over all partitions: a number of a partition is never that of another
    members = written(members.withColumn("own_block", F.when(F.col("n") > block, F.expr(f"monotonically_increasing_id() div {block}")).otherwise(0)), "ngram-members")
    # the sets of members only, from their first documents
    want = written(members.select(F.col("first").alias("_id")).distinct(), "ngram-wanted")
    sets = join_small(base, want, "_id", "left_semi").select("_id", "_text").mapInArrow(_keyed_sets, "_id long, _key binary, own array<long>")
    if rows.groupBy("_id", "_key").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        sets = sets.dropDuplicates(["_id", "_key"])  # rows that repeat an id with the same words
    place = members.select(F.col("first").alias("_id"), "_key", "id", "comp", "copies", "n", "own_block")
    prefix = F.substring("label", F.lit(1), 4 * chosen[F.col("tree")]).alias("prefix")
    split = runs.select("id", "tree", prefix).join(place.where(F.col("n") > block).select("id", "comp", "own_block"), "id")
    held = split.groupBy("comp", "tree", "prefix", "own_block").agg(F.lit(1).alias("_one"))
    met = held.select("comp", "tree", "prefix", F.col("own_block").alias("i")).join(held.select("comp", "tree", "prefix", F.col("own_block").alias("j")), ["comp", "tree", "prefix"])
    met = written(met.where("i <= j").select("comp", "i", "j").distinct(), "ngram-blocks")
    sides = met.withColumn("own_block", F.col("i")).unionByName(met.where("i < j").withColumn("own_block", F.col("j")))
    alone = place.where(F.col("n") <= block).withColumns({"i": F.col("own_block"), "j": F.col("own_block")})
    place = alone.unionByName(place.where(F.col("n") > block).join(sides, ["comp", "own_block"]))
    side = F.when(F.col("i") == F.col("j"), 0).when(F.col("own_block") == F.col("i"), 1).otherwise(2)
    dealt = sets.join(place, ["_id", "_key"]).select("comp", "i", "j", "id", side.alias("side"), "copies", "own")
    dealt = dealt.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "id")
    links = written(dealt.mapInArrow(_verify(threshold), "id long, root long, links long, texts long"), "ngram-links")
    counts = links.groupBy("id").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    linked = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")), "ngram-classes")
    # the class of a text is named by the smallest document id in it
    named = texts.join(linked, "id", "left").withColumn("root", F.coalesce("root", "id"))
    lowest = named.groupBy("root").agg(F.min("first").alias("class_id"), F.min("first_row").alias("class_row"))
    facts = named.join(lowest, "root").join(counts, "id", "left").select("_key", "class_id", "class_row", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("texts", F.lit(0)).alias("texts"), "copies")
    return rows.select("_id", "_tx", "_key").join(facts, "_key").select(
        unkeyed("_id").alias(id_col), unkeyed("class_id").alias("class_id"), (F.col("copies") - 1 + F.col("links")).alias("n_links"), F.col("texts").alias("n_texts"), F.col("copies").alias("n_copies"),
        F.col("_tx").alias("text_hash"), (F.struct("_id", "_tx") == F.col("class_row")).alias("is_first"),
    )


def row_hash(text: Column) -> Column:
    """With the id, this tells rows apart that repeat an id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _keyed_sets(batches):
    for b in batches:
        words = [word_hashes(t or "") for t in b.column(1).to_pylist()]
        own = [shingles(w).view(np.int64) for w in words]
        sizes = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
        flat = np.concatenate(own) if own else np.array([], np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([text_key(w) for w in words], pa.binary()), pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat, pa.int64()))], ["_id", "_key", "own"])
