"""Phrase collocations: minimal perfect hashes over Apriori-safe candidates, counted in numpy arrays by slot.

Texts become numbers: each word that occurs MIN_COUNT times in its language gets one, from its slot in a perfect hash; other
words and the ends of pieces are 0. (A sieve, as below, lets most rare words go before words are counted.) A phrase of k words is the pair of the numbers of its first and last k - 1 words,
and only pairs of two frequent ones are looked at (Apriori). For each k:

1. Mappers count the pairs in the cells of two hashes, the sieve. A pair with a cell that holds less than MIN_COUNT is
   out, which drops no frequent one.
2. The distinct pairs that are left, met by ranges of their hash, are the candidates. They are hashed in rounds of ROUND at most: the perfect hash of a
   round, with its keys, is broadcast, mappers bincount the slots whose stored key is the pair, the arrays are summed in a
   tree, and the counts are exact.
3. The frequent ones get numbers by slot, which take the place of the last level's in the texts.

Counts of all parts of a phrase then come by number from the tables of the levels: those of its beginnings from its first
pair, those of its ends from its last. What the driver holds and broadcasts is bounded by ROUND and SIEVE, whatever the
corpus: more candidates are more rounds, each a pass over the numbers. Numbers have 32 bits at a level.

Defined cases: a null text has no words, a null lang is `und`; an empty table gives no rows; equal rows count each; ids
aren't read; words of any length are whole (beyond KEY bytes they are known by their SHA-256).
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelens.llm import common
from framelens.llm.common import join_small
from framelens.llm.perfect_hash import PerfectHash, mixed

MIN_COUNT, MAX_WORDS, TOP, SCALE = 100, 5, 2000, 1000
#: Keys of a perfect hash, cells of a hash of the sieve (most, and words for each), and bytes of a word's key (most, and about).
ROUND, SIEVE, LOAD, KEY, BYTES_A_WORD = 1 << 21, 1 << 23, 16, 48, 6
#: Slots of a row of an array that is summed, arrays that are summed in a step of the tree, and ranges of candidates.
CHUNK, FAN, RANGES = 1 << 18, 16, 64
#: Numbers in a row (and one text more): less than half of a region of the JVM's heap.
ROW = 1 << 16
#: What a task holds at once: distinct words, pairs, and bytes of texts (and one text more).
WORDS, PAIRS, BYTES = 1 << 18, 1 << 18, 1 << 18


def written(df: DataFrame, name: str) -> DataFrame:
    """A table whose arrays tasks have packed already: Parquet's own codecs hold much memory outside the heap."""
    return common.written(df, name, codec="uncompressed")


def packed(array: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(array.tobytes())


def unpacked(data, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


BREAK = b"."
#: A-Z in lower case, tabs as spaces, and all ends of pieces as one.
_FOLD = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\n\x0b\x0c\r\t", bytes(range(97, 123)) + BREAK * 10 + b" ")


def words_of(text: bytes) -> list[bytes]:
    """The words of a text in order, with BREAK between pieces."""
    return text.translate(_FOLD).replace(BREAK, b" . ").split()


def _groups(batches):
    """Lists of rows (lang, text and what else there is) of about BYTES."""
    group, size = [], 0
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        for k in range(0, batch.num_rows, 64):
            cols = [(texts if i == 1 else batch.column(i)).slice(k, 64).to_pylist() for i in range(batch.num_columns)]
            for row in zip(*cols, strict=True):
                group.append(row)
                size += len(row[1])
                if size >= BYTES:
                    yield group
                    group, size = [], 0
    if group:
        yield group


def _counted_words(batches):
    """Counters of words by language, emptied when they hold WORDS."""
    counts: dict[str, Counter] = {}
    for group in _groups(batches):
        for lang, text in group:
            counts.setdefault(lang, Counter()).update(words_of(text))
        if sum(map(len, counts.values())) > WORDS:
            yield counts
            counts = {}
    yield counts


def _word_hashes(lang: str, words) -> np.ndarray:
    import xxhash

    start = lang.encode()
    return np.fromiter((xxhash.xxh3_64_intdigest(_key(start, w)) for w in words), np.uint64, len(words))


def _word_keys(batches):
    """Hashes of words and how often they occur."""
    for counts in _counted_words(batches):
        for lang, c in counts.items():
            c.pop(BREAK, None)
            yield _word_hashes(lang, c), np.fromiter(c.values(), np.int64, len(c))


def _count_words(shared):
    """Words that the sieve lets through and their counts, packed by language and range of their hash, and those of all words of a language under a null
    word: once a task, but for WORDS of them."""

    def out(held):
        for lang, c in held.items():
            every, words = c.pop(None), list(c)
            at = (_word_hashes(lang, words) >> np.uint64(58)).astype(np.int64).tolist()
            by: dict[int, list] = {0: [(None, every)]}
            for r, w in zip(at, words, strict=True):
                by.setdefault(r, []).append((w, c[w]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(by.keys(), pa.int32()), pa.array([lang] * len(by)), pa.array([[w for w, _ in x] for x in by.values()], pa.list_(pa.binary())), pa.array([[n for _, n in x] for x in by.values()], pa.list_(pa.int64()))], ["range", "lang", "words", "counts"]
            )

    def run(batches):
        held: dict[str, Counter] = {}
        for counts in _counted_words(batches):
            for lang, c in counts.items():
                c.pop(BREAK, None)
                often = _alive(_word_hashes(lang, c), shared.value) if c else []
                own = held.setdefault(lang, Counter())
                own.update({w: n for (w, n), ok in zip(c.items(), often, strict=True) if ok})
                own[None] += c.total()
            if sum(map(len, held.values())) > WORDS:
                yield from out(held)
                held = {}
        yield from out(held)

    return run


def _merged_words(least: int):
    """lang, word and n of the words that occur often enough, from rows in order of their range; and the null words."""

    def out(sums):
        for lang, c in sums.items():
            often = [(w, n) for w, n in c.items() if w is None or n >= least]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(often)), pa.array([w for w, _ in often], pa.binary()), pa.array([n for _, n in often], pa.int64())], ["lang", "word", "n"])

    def run(batches):
        at, sums = None, {}
        for b in batches:
            for k in range(b.num_rows):
                r, lang, words, counts = (b.column(i)[k].as_py() for i in range(4))
                if r != at:
                    yield from out(sums)
                    at, sums = r, {}
                own = sums.setdefault(lang, Counter())
                for w, n in zip(words, counts, strict=True):
                    own[w] += n
        yield from out(sums)

    return run


# -- word numbers

def _key(lang: bytes, word: bytes) -> bytes:
    key = lang + b"\t" + word  # a word has no tab
    return key if len(key) <= KEY else hashlib.sha256(key).hexdigest().encode()


def key_column() -> Column:
    key = F.concat(F.col("lang").cast("binary"), F.lit(b"\t"), F.col("word"))
    return F.when(F.octet_length(key) <= KEY, key).otherwise(F.sha2(key, 256).cast("binary"))


class WordHash:
    """Numbers of words from `base` on, by the perfect hash of their hashes; the words' own keys are stored and compared."""

    def __init__(self, keys: list[bytes], base: int):
        import xxhash

        self.base, self.seed = base, 0
        while True:
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(k, self.seed) for k in keys), np.uint64, len(keys))
            if len(np.unique(hashes)) == len(keys):
                break
            self.seed += 1
        self.hash = PerfectHash(hashes)
        self.keys = np.empty(len(keys), object)
        self.keys[self.hash.places(hashes)] = keys

    def numbers(self, keys: list[bytes]) -> list[int]:
        """0 for any key that isn't among them."""
        import xxhash

        at = self.hash.places(np.fromiter((xxhash.xxh3_64_intdigest(k, self.seed) for k in keys), np.uint64, len(keys)))
        return [p + self.base if p >= 0 and self.keys[p] == k else 0 for p, k in zip(at.tolist(), keys, strict=True)]


def _row(arrays: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([packed(np.concatenate(arrays))], pa.binary())], ["s"])


def _number_texts(shared, last: bool):
    """Texts as numbers, added to those that earlier rounds gave to other words (`s`). The last round gives rows of whole texts, with
    0 between them; others a row for each text."""

    def run(batches):
        known: dict[str, dict[bytes, int]] = {}
        held: list[np.ndarray] = []
        size = 0
        for group in _groups(batches):
            if sum(map(len, known.values())) > WORDS:
                known.clear()
            split = [words_of(row[1]) for row in group]
            new: dict[str, set[bytes]] = {}
            for (lang, *_), words in zip(group, split, strict=True):
                new.setdefault(lang, set()).update(words)
            for lang, words in new.items():
                memory = known.setdefault(lang, {BREAK: 0})
                missing = [w for w in words if w not in memory]
                memory.update(zip(missing, shared.value.numbers([_key(lang.encode(), w) for w in missing]), strict=True))
            each = []
            for (lang, _, s), words in zip(group, split, strict=True):
                numbers = np.fromiter(map(known[lang].__getitem__, words), np.uint32, len(words))
                each.append(numbers | np.frombuffer(s, np.uint32) if s else numbers)
            if not last:
                cols = [pa.array([row[0] for row in group]), pa.array([row[1] for row in group], pa.binary()).cast(pa.string()), pa.array([n.tobytes() for n in each], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["lang", "text", "s"])
                continue
            for numbers in each:
                held += [numbers, np.zeros(1, np.uint32)]
                size += len(numbers) + 1
                if size > ROW:
                    yield _row(held)
                    held, size = [], 0
        if size:
            yield _row(held)

    return run


# -- pairs of numbers

def _rows(batches):
    for batch in batches:
        for s in batch.column(0):
            yield unpacked(s.as_buffer(), np.uint32)


def _pairs(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where two numbers stand side by side, and the two as one."""
    at = np.flatnonzero((s[:-1] != 0) & (s[1:] != 0))
    return at, (s[at].astype(np.uint64) << np.uint64(32)) | s[at + 1].astype(np.uint64)


def _cells(pairs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells of both hashes; those of the second follow those of the first."""
    h, mask = mixed(pairs, 97), np.uint64((1 << width) - 1)
    return (h >> np.uint64(64 - width)).astype(np.int64), ((h >> np.uint64(64 - 2 * width)) & mask).astype(np.int64) + (1 << width)


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _chunks(counts: np.ndarray):
    """The parts of an array that aren't all zero, in the smallest type that holds them, each with its number and the task's."""
    for k in range(0, len(counts), CHUNK):
        part = counts[k : k + CHUNK]
        if part.any():
            yield _chunk_row(k // CHUNK, part)


def _chunk_row(chunk: int, part: np.ndarray) -> pa.RecordBatch:
    small = part.astype(np.min_scalar_type(int(part.max())), copy=False)
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([_task()], pa.int64()), pa.array([small.dtype.str]), pa.array([packed(small)], pa.binary())], ["chunk", "branch", "kind", "counts"])


ARRAYS = "chunk long, branch long, kind string, counts binary"


def _pair_keys(batches):
    """Pairs of many rows at a time, each once."""
    held, size = [], 0
    for s in _rows(batches):
        held.append(_pairs(s)[1])
        size += len(held[-1])
        if size > 2 * PAIRS:
            yield np.concatenate(held), None
            held, size = [], 0
    if size:
        yield np.concatenate(held), None


def _sieved(keys, width: int, least: int):
    """How many keys lie in each cell of the sieve; counts beyond `least` needn't be told apart. keys: from batches to keys and how often each
    occurs (None: once)."""

    def run(batches):
        counts = np.zeros(2 << width, np.min_scalar_type(least))
        for found, n in keys(batches):
            cells, where = np.unique(np.concatenate(_cells(found, width)), return_inverse=True)
            more = np.bincount(where, None if n is None else np.concatenate([n, n])).astype(np.int64)
            counts[cells] = np.minimum(counts[cells] + more, least)
        yield from _chunks(counts)

    return run


def _sieve(df: DataFrame, keys, width: int, least: int) -> np.ndarray:
    cells = tree_sum(written(df.mapInArrow(_sieved(keys, width, least), ARRAYS), "phrase-sieve"), 2 << width, least)
    return np.packbits(cells >= least, bitorder="little")


def _alive(pairs: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    width = (len(sieve) * 4).bit_length() - 1
    first, second = ((sieve[c >> 3] >> (c & 7)) & 1 for c in _cells(pairs, width))
    return (first & second) == 1


def _ranged(pairs: np.ndarray) -> pa.RecordBatch:
    """Distinct pairs, packed by the range of their hash."""
    at = (mixed(pairs, 13) >> np.uint64(58)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    cuts = np.searchsorted(at[order], np.arange(RANGES + 1))
    full = [r for r in range(RANGES) if cuts[r] < cuts[r + 1]]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([pairs[order[cuts[r] : cuts[r + 1]]].tobytes() for r in full], pa.binary())], ["range", "pairs"])


def _candidates(shared):
    def run(batches):
        known, held, size = np.zeros(0, np.uint64), [], 0
        for s in _rows(batches):
            pairs = _pairs(s)[1]
            held.append(np.unique(pairs[_alive(pairs, shared.value)]))
            size += len(held[-1])
            if size > PAIRS:
                known, held, size = np.unique(np.concatenate([known, *held])), [], 0
                if len(known) > 2 * PAIRS:
                    yield _ranged(known)
                    known = known[:0]
        known = np.unique(np.concatenate([known, *held]))
        if len(known):
            yield _ranged(known)

    return run


def _merged(batches):
    """The distinct pairs of each range."""
    known: dict[int, list[np.ndarray]] = {}
    held = 0
    for b in batches:
        for r, pairs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            known.setdefault(r, []).append(np.frombuffer(pairs, np.uint64))
            held += len(pairs) // 8
            if held > 2 * PAIRS:
                known = {k: [np.unique(np.concatenate(parts))] for k, parts in known.items()}
                held = 0
    for parts in known.values():
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(parts)).view(np.int64), pa.int64())], ["pair"])


def _counted(shared):
    def run(batches):
        sieve, perfect = shared.value
        counts = np.zeros(len(perfect), np.int64)
        for s in _rows(batches):
            pairs = _pairs(s)[1]
            at = perfect.slots(pairs[_alive(pairs, sieve)])
            counts += np.bincount(at[at >= 0], minlength=len(perfect))
        yield from _chunks(counts)

    return run


def _renumbered(shared):
    """The numbers of the longer phrases in place of those of their first parts; `t` has what earlier rounds found."""

    def run(batches):
        sieve, perfect, numbers = shared.value
        for batch in batches:
            for s, t in zip(batch.column(0), batch.column(1), strict=True):
                own = unpacked(s.as_buffer(), np.uint32)
                t = unpacked(t.as_buffer(), np.uint32).copy() if t.is_valid else np.zeros(len(own), np.uint32)
                at, pairs = _pairs(own)
                some = _alive(pairs, sieve)
                at, slot = at[some], perfect.slots(pairs[some])
                t[at[slot >= 0]] = numbers[slot[slot >= 0]]
                yield pa.RecordBatch.from_arrays([pa.array([s.as_py()], pa.binary()), pa.array([packed(t)], pa.binary())], ["s", "t"])

    return run


# -- sums

def _summed(least: int | None):
    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, kind, counts in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                part = unpacked(counts, kind)
                if chunk in sums:
                    total = sums[chunk].astype(np.int64) + part
                    part = total if least is None else np.minimum(total, least)
                sums[chunk] = part.astype(np.min_scalar_type(int(part.max())), copy=False)
        for chunk, part in sums.items():
            yield _chunk_row(chunk, part)

    return run


def tree_sum(arrays: DataFrame, size: int, least: int | None = None) -> np.ndarray:
    """The sum of the arrays that tasks have written, FAN by FAN; only the last one, of `size` numbers, comes back."""
    branches = arrays.agg(F.count_distinct("branch")).first()[0]
    while branches > 1:
        branches = -(-branches // FAN)
        arrays = written(arrays.coalesce(branches).mapInArrow(_summed(least), ARRAYS), "phrase-sums")
    out = np.zeros(size, np.int64)
    for r in arrays.toLocalIterator():
        part = unpacked(r["counts"], r["kind"])
        at = slice(r["chunk"] * CHUNK, r["chunk"] * CHUNK + len(part))
        out[at] += part
    return out if least is None else np.minimum(out, least)


# -- levels

def _rounds(df: DataFrame, key: str, size: int) -> list[DataFrame]:
    """A written table in parts of about `size` rows, dealt by hash."""
    n = -(-df.count() // size)
    return [df.where(F.pmod(F.xxhash64(key, F.lit(5)), F.lit(n)) == k) for k in range(n)]


def _numbered(first: int, found: int) -> None:
    if first + found > 2**32:
        raise ValueError("a level has more than 2**32 frequent phrases")


def _word_level(words: DataFrame, texts: DataFrame, size: int) -> tuple[DataFrame, DataFrame | None]:
    """The level of single words, and the texts as numbers. words: lang, word, n."""
    spark, base, level, rows = words.sparkSession, 1, None, texts.withColumn("s", F.lit(None).cast("binary"))
    rounds = _rounds(words, "key", size)
    for k, part in enumerate(rounds):
        keys = part.select("key").toArrow().column(0).to_pylist()
        _numbered(base, len(keys))
        shared = spark.sparkContext.broadcast(WordHash(keys, base))

        def identified(batches, shared=shared):
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(shared.value.numbers(b.column(0).to_pylist()), pa.int64())], ["lang", "word", "n", "id"])

        ids = written(part.select("key", "lang", "word", "n").mapInArrow(identified, "lang string, word binary, n long, id long"), "phrase-level")
        level = ids if level is None else level.unionByName(ids)
        last = k == len(rounds) - 1
        rows = written(rows.mapInArrow(_number_texts(shared, last), "s binary" if last else "lang string, text string, s binary"), "phrase-numbers")
        shared.unpersist()
        base += len(keys)
    if level is None:
        return _no_phrases(spark), None
    text = F.col("word").cast("string")
    return level.select("id", "lang", text.alias("text"), text.alias("last_word"), F.array("n").alias("starts"), F.array("n").alias("ends"), F.col("n").alias("f")), rows


def _no_phrases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "id long, lang string, text string, last_word string, starts array<long>, ends array<long>, f long")


def _frequent_pairs(rows: DataFrame, width: int, least: int, size: int, renumber: bool) -> tuple[DataFrame | None, DataFrame]:
    """first, last, f and id of the pairs of numbers side by side that occur `least` times, and the rows with the ids of those pairs."""
    spark = rows.sparkSession
    put = spark.sparkContext.broadcast
    sieve = _sieve(rows, _pair_keys, width, least)
    shared_sieve = put(sieve)
    ranged = rows.mapInArrow(_candidates(shared_sieve), "range int, pairs binary").repartition("range")
    pairs = written(ranged.mapInArrow(_merged, "pair long"), "phrase-candidates")
    base, level, out = 1, None, rows.withColumn("t", F.lit(None).cast("binary"))
    for part in _rounds(pairs, "pair", size):
        perfect = PerfectHash(part.toArrow().column(0).to_numpy().view(np.uint64))
        shared = put((sieve, perfect))
        counts = tree_sum(written(rows.mapInArrow(_counted(shared), ARRAYS), "phrase-arrays"), len(perfect))
        shared.unpersist()
        often = counts >= least
        _numbered(base, int(often.sum()))
        numbers = np.where(often, base + np.cumsum(often) - 1, 0).astype(np.uint32)
        by_slot = put((perfect.keys, counts, numbers))

        def read(batches, by_slot=by_slot):
            keys, counts, numbers = by_slot.value
            for b in batches:
                at = b.column(0).to_numpy()
                at = at[numbers[at] > 0]
                cols = (keys[at] >> np.uint64(32), keys[at] & np.uint64(2**32 - 1), counts[at], numbers[at])
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["first", "last", "f", "id"])

        found = written(spark.range(len(perfect)).mapInArrow(read, "first long, last long, f long, id long"), "phrase-pairs")
        level = found if level is None else level.unionByName(found)
        if renumber and often.any():
            shared_all = put((sieve, perfect, numbers))
            out = written(out.mapInArrow(_renumbered(shared_all), "s binary, t binary"), "phrase-numbers")
            shared_all.unpersist()
        by_slot.unpersist()
        base += int(often.sum())
    shared_sieve.unpersist()
    return (level if base > 1 else None), out.select(F.col("t").alias("s"))


def _joined(pairs: DataFrame, below: DataFrame) -> DataFrame:
    """The level of phrases: the text, and the counts of all beginnings and ends, shortest first."""
    a = below.select(F.col("id").alias("first"), "lang", F.col("text").alias("_text"), F.col("starts").alias("_starts"))
    b = below.select(F.col("id").alias("last"), "last_word", F.col("ends").alias("_ends"))
    x = join_small(join_small(pairs, a, "first", "inner"), b, "last", "inner")
    grown = lambda c: F.concat(c, F.array("f"))
    return x.select("id", "lang", F.concat_ws(" ", "_text", "last_word").alias("text"), "last_word", grown("_starts").alias("starts"), grown("_ends").alias("ends"), "f")


def _scored(phrases: DataFrame, scale: int) -> DataFrame:
    """a, l, r and score of the lowest-scoring cut; of equal scores the one with the shortest first part."""
    big = lambda x: f"CAST({x} AS DECIMAL(19, 0))"
    left, right = "starts[m - 1]", "ends[size(ends) - m - 1]"
    cut = f"named_struct('score', ({scale} * {big('f')} * {big('n')}) div ({big(left)} * {big(right)}), 'm', m, 'l', {left}, 'r', {right})"
    low = F.expr(f"array_min(transform(sequence(1, size(starts) - 1), m -> {cut}))")
    return phrases.withColumn("_cut", low).select("lang", F.col("text").alias("phrase"), F.col("f").alias("a"), F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"), "n", F.col("_cut.score").alias("score"))


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = MIN_COUNT, longest: int = MAX_WORDS, top: int = TOP, scale: int = SCALE, cover: int = 100, size: int = ROUND, sieve: int = SIEVE
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best `top` phrases of 2 to `longest` words of each language. A phrase goes if a longer one that holds
    it occurs at least `cover` percent as often. size: keys of a perfect hash; sieve: most cells of the sieve."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size_of_all = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = min(sieve.bit_length() - 1, max(16, (size_of_all // (LOAD * BYTES_A_WORD)).bit_length()))
    shared = spark.sparkContext.broadcast(_sieve(texts, _word_keys, width, least))
    ranged = texts.mapInArrow(_count_words(shared), "range int, lang string, words array<binary>, counts array<long>").repartition("range").sortWithinPartitions("range")
    counts = written(ranged.mapInArrow(_merged_words(least), "lang string, word binary, n long"), "phrase-counts")
    shared.unpersist()
    totals = written(counts.where("word IS NULL AND n > 0").select("lang", "n"), "phrase-totals")
    words = written(counts.where("word IS NOT NULL").withColumn("key", key_column()), "phrase-frequent")
    below, rows = _word_level(words, texts, size)
    below = written(below, "phrase-level")

    kept = _no_phrases(spark)
    for k in range(2, longest + 1):
        pairs, rows = _frequent_pairs(rows, width, least, size, k < longest) if rows is not None else (None, None)
        if pairs is None:
            kept = kept.unionByName(below) if k > 2 else kept
            break
        if k > 2:  # a longer phrase that holds this one holds it with one word more, which occurs at least as often
            held = written(pairs.select(F.explode(F.array("first", "last")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("longer")), "phrase-longer")
            kept = kept.unionByName(join_small(below, held, "id", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("f"))).drop("longer"))
        below = written(_joined(pairs, below), "phrase-level")
        if k == longest:
            kept = kept.unionByName(below)
    scored = _scored(join_small(kept, totals, "lang", "inner", rows=100_000), scale)
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    cell = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*best)
    few = scored.withColumn("_at", F.row_number().over(cell)).where(F.col("_at") <= top).drop("_at")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
