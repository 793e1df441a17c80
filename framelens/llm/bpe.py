"""Byte-level BPE by Spark higher-order functions.

A text is split by the public pattern in the JVM, each match is a word. In one narrow stage, without a
shuffle, three steps follow each other on every partition:

1. an Arrow function replaces the words by numbers and hands on each distinct word of the task once: its
   bytes as a string of the code points 0 to 255, and as the parts that the fold begins with, one a byte;
2. a fold over each distinct word's parts does the ranked merges: of all neighbours the pair of lowest
   rank, leftmost first, joins, until no pair has a rank. Ranks come from an array of maps from pieces, in
   buckets by hash, so that a look-up costs the same at any vocabulary size; it is the only row of a broadcast
   table, as a literal would stand in every text of the plan that the driver keeps and in every task. The state
   of a fold is one array: for each part the rank of its pair with the next part, where it begins and its own
   id, in the bits of a number, so that the smallest element is the next merge and the last state has the ids;
3. an Arrow function takes the pieces of the ids, so that they are decoded again, and puts the ids and the pieces of
   each document together.

The word memory of a task is emptied beyond MEMORY_WORDS. The fold is quadratic in a word's length, so
words over LONG_WORD bytes (long runs of one kind of character) are merged in step 3 with a heap instead.
Both routes do the same: a heap of (rank, place) gives the pair of lowest rank, leftmost first, as the smallest
element of the fold's array does, and an entry whose parts have since been joined is passed over; each
merge adds the same two pairs. The tests hold both routes, and the library, against each other on the same
words.

The letter and number classes of the JVM are older than the library's. `java_pattern` asks both for the class
of every code point and writes the difference into the pattern.

Defined cases: a null or empty text has no ids; rows that repeat a doc_id get a row each; an empty table
gives no rows; special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelens.llm.common import bound, keyed, small_batches, unkeyed

MEMORY_WORDS = 1_000_000
LONG_WORD = 512
#: Most words of a block, the unit in which documents go through the steps; a longer text is a block by itself.
BLOCK_WORDS = 500_000
BUCKETS = 1 << 17
#: Bits of an id or rank, and of a place in a word of at most MOST_FOLDED bytes: both ids and the place fit in a long.
ID_BITS, PLACE_BITS = 26, 10
MOST_FOLDED = (1 << PLACE_BITS) - 2
#: Rank of no pair.
NONE = 1 << ID_BITS


def _every() -> str:
    return "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))


def library_class(name: str) -> set[int]:
    """The code points that the tokenizer library takes for members of a class."""
    import tiktoken

    one = tiktoken.Encoding("class", pat_str=name, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    return set(map(ord, one.decode(one.encode_ordinary(_every()))))


def java_class(spark: SparkSession, name: str) -> set[int]:
    """The same for the JVM's regular expressions."""
    kept = spark.createDataFrame([(_every(),)], "t string").select(F.regexp_replace("t", f"[^{name}]+", "")).first()[0]
    return set(map(ord, kept))


def _ranges(points: set[int]) -> str:
    out: list[list[int]] = []
    for x in sorted(points):
        if out and out[-1][1] == x - 1:
            out[-1][1] = x
        else:
            out.append([x, x])
    return "".join(rf"\x{{{a:X}}}" + (rf"-\x{{{b:X}}}" if b > a else "") for a, b in out)


def _member(name: str, more: set[int], less: set[int]) -> tuple[str, str]:
    """A class of the JVM with more and less code points, and its complement. A range that holds all of `more` is
    asked first, so that common characters cost no long list of ranges."""
    inside, outside = name, f"[^{name}]"
    if more:
        low = min(more)
        inside = rf"[{inside}[[\x{{{low:X}}}-\x{{10FFFF}}]&&[{_ranges(more)}]]]"
        outside = rf"[{outside}&&[[\x{{0}}-\x{{{low - 1:X}}}][^{_ranges(more)}]]]"
    if less:
        inside, outside = f"[{inside}&&[^{_ranges(less)}]]", f"[{outside}[{_ranges(less)}]]"
    return inside, outside


#: The JVM's form of a pattern, by application: it takes Spark jobs over every code point.
_PATTERNS: dict[tuple[str, str], str] = {}


def java_pattern(spark: SparkSession, pattern: str) -> str:
    """The pattern for the JVM, with the library's classes, worked out once an application."""
    key = (spark.sparkContext.applicationId, pattern)
    if key not in _PATTERNS:
        _PATTERNS[key] = _java_pattern(spark, pattern)
    return _PATTERNS[key]


def _java_pattern(spark: SparkSession, pattern: str) -> str:
    """Words of letters or digits are tried first, and without
    backtracking: no other alternative begins as they do, so the matches stay the same."""
    words = (r" ?\p{L}+", r" ?\p{N}+")
    if all(f"|{w}|" in pattern for w in words):
        for w in words:
            pattern = pattern.replace(f"|{w}|", "|")
        pattern = "|".join([w.replace("?", "?+").replace("}+", "}++") for w in words] + [pattern])
    classes = ((c, library_class(c), java_class(spark, c)) for c in (r"\p{L}", r"\p{N}"))
    letter, digit = (_member(c, there - here, here - there) for c, there, here in classes)
    space = _ranges(library_class(r"\s"))
    put = [(r"[^\s\p{L}\p{N}]", f"[[^{space}]&&{letter[1]}&&{digit[1]}]"), (r"\p{L}", letter[0]), (r"\p{N}", digit[0]), (r"\S", f"[^{space}]"), (r"\s", f"[{space}]")]
    for i, (old, _) in enumerate(put):  # by marks first, as what is put in holds such names itself
        pattern = pattern.replace(old, f"\x00{i}\x00")
    for i, (_, new) in enumerate(put):
        pattern = pattern.replace(f"\x00{i}\x00", new)
    return pattern


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def rank_table(spark: SparkSession, ranks: dict[bytes, int]) -> DataFrame:
    """One row, _ranks: an array of BUCKETS maps from a piece to its rank; a piece stands in the bucket of its hash. Empty
    buckets are null, so that most look-ups of what is no piece end there."""
    table: list[dict[str, int] | None] = [None] * BUCKETS
    for piece, rank in ranks.items():
        s = piece.decode("latin-1")
        k = xxhash.xxh64_intdigest(s.encode(), seed=42) % BUCKETS
        table[k] = (table[k] or {}) | {s: rank}
    return spark.createDataFrame([(json.dumps(table),)], "_json string").select(F.from_json("_json", "array<map<string,int>>").alias("_ranks"))


def _rank(x: str) -> str:
    # xxhash64 is signed and BUCKETS a power of two, so & gives the bucket of the unsigned hash
    return f"coalesce(try_element_at(m[cast(xxhash64({x}) & {BUCKETS - 1} as int)], {x}), {NONE})"


def _let(var: str, value: str, body: str) -> str:
    """SQL text that evaluates `value` once and `body` with it as `var`."""
    return f"transform(array_repeat({value}, 1), {var} -> {body})[0]"


# An element of the state: the rank of its pair, the place where its part begins, from 1, and the part's id.
_PLACE, _PAIR = ID_BITS, ID_BITS + PLACE_BITS
_ID_MASK, _PLACE_MASK = (1 << _PLACE) - 1, ((1 << PLACE_BITS) - 1) << _PLACE


def _begin(x: str) -> str:
    return f"cast(shiftright({x} & {_PLACE_MASK}L, {_PLACE}) as int)"


def _joined(x: str, after: str) -> str:
    """Rank of the word's bytes from where x begins to where `after` does; of none, where there is no such element."""
    return _rank(f"substring(w, {_begin(x)}, {_begin(after)} - {_begin(x)})")


# s: an element for each part, and one where the word ends. k: the place of the smallest, from 1, so s[k] is the part that
# joins it and goes. Only that and the one before the smallest change besides; a joined part's id is the rank that its pair had.
# x: each element, i: its place from 0.
_CHANGED = f"{_joined('x', 'get(s, i + 3)')} * {1 << _PAIR}L + if(i < k - 1, x & {_PLACE_MASK | _ID_MASK}L, (x & {_PLACE_MASK}L) + shiftright(x, {_PAIR}))"
_MERGE = f"array_remove(transform(s, (x, i) -> if(i > k or i < k - 2, x, if(i = k, -1L, {_CHANGED}))), -1L)"
_STEP = _let("k", "cast(array_position(s, array_min(s)) as int)", f"if(s[k - 1] >= {NONE << _PAIR}L, s, {_MERGE})")
#: The last state of a word, of whose elements but the last the low bits are the ids. A word that is a piece itself is one part.
_FOLD = _let("r", _rank("w"), f"if(r <> {NONE}, array(cast(r as bigint), 0L), aggregate(sequence(1, length(w) - 1), parts[n], (s, _) -> {_STEP}))")


def heap_merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a long word: ranked merges, lowest rank first, leftmost of equal ranks."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end = list(range(1, n + 1))  # end of the part that begins at i; 0 where none does
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != stop:
            continue
        end[i], end[mid] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (j := before[i]) >= 0 and (r := ranks.get(word[j:stop])) is not None:
            heapq.heappush(heap, (r, j, stop))
    return [ranks[word[i:e]] for i, e in enumerate(end) if e]


def first_parts(ranks: dict[bytes, int]):
    """A function from words to the states that their folds begin with."""
    single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
    pair = np.full(1 << 16, NONE, np.int64)
    for piece, rank in ranks.items():
        if len(piece) == 2:
            pair[piece[0] * 256 + piece[1]] = rank

    def of(words: list[bytes]) -> pa.Array:
        flat = np.frombuffer(b"\0".join(words) + b"\0", np.uint8).astype(np.int32)
        sizes = np.array([len(w) + 1 for w in words])
        ends = np.cumsum(sizes)
        rank = pair[flat * 256 + np.append(flat[1:], 0)]
        rank[ends - 1] = rank[ends - 2] = NONE
        place = np.arange(1, len(flat) + 1) - np.repeat(ends - sizes, sizes)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array((rank << _PAIR) | (place << _PLACE) | single[flat]))

    return of


def _number(long_word: int, parts_of):
    """Step 1: (id, words) to one row a block: the words new to the task, and the documents as word numbers."""

    def blocks(offsets):
        at = 0
        while at < len(offsets) - 1:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_WORDS, "right")) - 1)
            yield at, end
            at = end

    def run(batches):
        known: dict[str, int] = {}
        turn = 0
        for b in batches:
            offsets = b.column(1).offsets.to_numpy()
            for at, end in blocks(offsets):
                if len(known) > MEMORY_WORDS:
                    known.clear()
                    turn += 1
                words = b.column(1).values[offsets[at] : offsets[end]].dictionary_encode()
                new, codes = [], np.empty(len(words.dictionary), np.int32)
                for i, w in enumerate(words.dictionary.to_pylist()):
                    if (c := known.get(w)) is None:
                        c = known[w] = len(known)
                        new.append(w.encode("utf-8", "surrogatepass"))
                    codes[i] = c
                flat = codes[words.indices.to_numpy()] if len(words) else np.array([], np.int32)
                text = [w.decode("latin-1") if len(w) <= long_word else None for w in new]
                parts = parts_of([w if len(w) <= long_word else b"?" for w in new]) if new else pa.array([], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([turn], pa.int32()), pa.array([text], pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array([0, len(new)], pa.int32()), parts), pa.array([[w for w in new if len(w) > long_word]], pa.list_(pa.binary())),
                     pa.array([b.column(0).to_pylist()[at:end]], pa.list_(pa.int64())), pa.array([np.diff(offsets[at : end + 1]).astype(np.int32)], pa.list_(pa.int32())), pa.array([flat], pa.list_(pa.int32()))],
                    ["turn", "words", "parts", "long", "ids", "sizes", "flat"],
                )

    return run


def _assemble(ranks, digests_only):
    """Step 3: what step 2 gave back, to a row for each document."""

    def run(batches):
        import hashlib

        ids_of: list[bytes] = []
        bytes_of: list[bytes] = []
        turn, table = -1, ranks.value
        by_id = [b""] * (max(table.values()) + 1)
        for piece, i in table.items():
            by_id[i] = piece
        pieces = pa.array(by_id, pa.binary())
        for b in batches:
            for row in range(len(b)):
                if b.column(0)[row].as_py() != turn:
                    turn = b.column(0)[row].as_py()
                    ids_of.clear()
                    bytes_of.clear()
                lists = b.column(1)[row].values
                # an element more than ids in each list, at its end; null for long words
                ends, folded = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.is_valid().to_numpy(zero_copy_only=False)
                last = np.zeros(ends[-1], bool)
                last[ends[1:][folded] - 1] = True
                own = (lists.flatten().to_numpy()[~last] & _ID_MASK).astype("<u4")
                ends = (ends - np.concatenate([[0], np.cumsum(folded)])).tolist()
                raw = own.tobytes()
                taken = pieces.take(pa.array(own))
                at = np.concatenate([[0], np.cumsum(pc.binary_length(taken).to_numpy(zero_copy_only=False))]).tolist()
                decoded = taken.buffers()[2].to_pybytes() if len(own) else b""
                long = iter(b.column(2)[row].as_py())
                for i, is_set in enumerate(folded.tolist()):
                    if is_set:
                        ids_of.append(raw[4 * ends[i] : 4 * ends[i + 1]])
                        bytes_of.append(decoded[at[ends[i]] : at[ends[i + 1]]])
                    else:
                        merged = heap_merge(next(long), table)
                        ids_of.append(np.array(merged, "<u4").tobytes())
                        bytes_of.append(b"".join(map(by_id.__getitem__, merged)))
                flat, at, out = b.column(5)[row].values.to_numpy(), 0, []
                for n in b.column(4)[row].values.to_numpy():
                    codes = flat[at : at + n].tolist()
                    at += n
                    e, d = b"".join(map(ids_of.__getitem__, codes)), b"".join(map(bytes_of.__getitem__, codes))
                    out.append((len(e) // 4, hashlib.sha256(e).hexdigest(), hashlib.sha256(d).hexdigest()) if digests_only else (len(e) // 4, np.frombuffer(e, "<u4").astype(np.int32), d))
                cols = list(zip(*out, strict=True)) if out else [(), (), ()]
                kinds = (pa.int64(), pa.string(), pa.string()) if digests_only else (pa.int64(), pa.list_(pa.int32()), pa.binary())
                names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests_only else ["n_tokens", "ids", "decoded"]
                yield pa.RecordBatch.from_arrays([pa.array(b.column(3)[row].values.to_numpy(), pa.int64()), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["_id", *names])

    return run


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests_only: bool = False, long_word: int = LONG_WORD) -> DataFrame:
    """id, n_tokens, ids (array<int>) and decoded (binary) for each row; digests_only: their digests instead of both.
    path: a rank file that the driver can read."""
    spark = docs.sparkSession
    small_batches(spark)
    ranks = load_ranks(path)
    # a rank file need not have all bytes or nothing but pieces of bytes; every single byte must have a rank
    if missing := [i for i in range(256) if bytes([i]) not in ranks]:
        raise ValueError(f"{path} has no rank for bytes {missing[:5]}")
    if max(ranks.values()) >= NONE:
        raise ValueError(f"{path} has ranks of {NONE} and more")
    base = docs.select(keyed(id_col).alias("_id"), F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(java_pattern(spark, pattern)), F.lit(0)).alias("_words"))
    numbered = base.mapInArrow(_number(min(long_word, MOST_FOLDED), first_parts(ranks)), "turn int, words array<string>, parts array<array<bigint>>, long array<binary>, ids array<long>, sizes array<int>, flat array<int>")
    # a row, which goes with every block of words
    both = numbered.crossJoin(F.broadcast(rank_table(spark, ranks)))
    # bound, as the name of a column inside a fold would be copied from the row at every look-up
    got = bound("_ranks", f"transform(words, (w, n) -> if(w is null, null, {_FOLD}))", "m")
    both = both.select("turn", F.expr(got).alias("got"), "long", "ids", "sizes", "flat")
    kept = "n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests_only else "ids array<int>, decoded binary")
    out = both.mapInArrow(_assemble(spark.sparkContext.broadcast(ranks), digests_only), "_id long, " + kept)
    return out.select(unkeyed("_id").alias(id_col), *out.columns[1:])
