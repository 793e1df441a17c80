"""JSON arrays in noisy text: recognised in one pass, accepted by a contract over streams and attempts, the rest set aside."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType
from pyspark.sql.window import Window

#: Arrays nested deeper than this or with longer whole numbers aren't taken, what lies in them is.
DEPTH, DIGITS = 200, 4000

_QUOTE = re.compile(r'\\.|"', re.S)
_STRING = re.compile(r'(?:[^\x00-\x1f"\\]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*')
_ATOM = re.compile(rf"[ \t\r\n]+|[][{{}}:,]|(?:-?(?:0|[1-9][0-9]{{0,{DIGITS - 1}}})(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)(?![\w.+-])")
#: What may come next in an open array or object, and then: a value, a name of a member, a colon, or the mark before the next one or the end.
_VALUE, _NAME, _COLON, _AFTER = range(4)


class _Open:
    __slots__ = ("begin", "closer", "depth", "empty", "wants")

    def __init__(self, begin: int, closer: str):
        self.begin, self.closer, self.depth, self.empty = begin, closer, 1, True
        self.wants = _VALUE if closer == "]" else _NAME


class _Recogniser:
    """Takes the tokens of one reading of a text and notes each array that is whole. A token that can't stand where it does ends all that is open:
    none of it can become JSON; what was whole within it stays noted."""

    def __init__(self):
        self.open: list[_Open] = []
        self.whole: list[tuple[int, int]] = []

    def _value_done(self, depth: int) -> None:
        if self.open:
            top = self.open[-1]
            top.wants, top.empty, top.depth = _AFTER, False, max(top.depth, depth + 1)

    def take(self, kind: str, begin: int, end: int) -> None:
        """kind: one of []{}:, or s for a string, a for a number or word, x for anything else."""
        top = self.open[-1] if self.open else None
        wants = top.wants if top else None
        if kind in "[{" and wants in (None, _VALUE):
            if top or kind == "[":
                self.open.append(_Open(begin, "]" if kind == "[" else "}"))
        elif top is None:
            return
        elif kind == top.closer and (wants == _AFTER or top.empty and wants != _COLON):
            self.open.pop()
            if kind == "]" and top.depth <= DEPTH:
                self.whole.append((top.begin, end))
            self._value_done(top.depth)
        elif kind in "sa" and wants == _VALUE:
            self._value_done(0)
        elif kind == "s" and wants == _NAME:
            top.wants, top.empty = _COLON, False
        elif kind == ":" and wants == _COLON:
            top.wants = _VALUE
        elif kind == "," and wants == _AFTER:
            top.wants = _VALUE if top.closer == "]" else _NAME
        else:
            self.open.clear()
            if kind == "[":
                self.open.append(_Open(begin, "]"))


def array_spans(text: str) -> list[tuple[int, int]]:
    """Where the JSON arrays of text lie that are in no other, in order, in time linear in its length.

    Whether a bracket is in a string depends on where the array began, but only by the number of unescaped quotes before it
    being even or odd, as the strings of an array take quotes in pairs. So there are two readings, each a single pass."""
    if "[" not in text:
        return []
    quotes = [m.start() for m in _QUOTE.finditer(text) if m[0] == '"']
    edges = [-1, *quotes, len(text)]
    found: list[tuple[int, int]] = []
    for reading in (0, 1):
        r = _Recogniser()
        for k in range(len(edges) - 1):
            begin, end = edges[k] + 1, edges[k + 1]
            if k % 2 != reading:
                if k:  # between two quotes, or from the last one to the end
                    whole = end < len(text) and _STRING.fullmatch(text, begin, end)
                    r.take("s" if whole else "x", begin - 1, end + 1)
                continue
            at = begin
            while at < end:
                if not r.open:  # prose up to the next bracket
                    at = text.find("[", at, end)
                    if at < 0:
                        break
                m = _ATOM.match(text, at, end)
                if m is None:
                    r.take("x", at, at + 1)
                    at += 1
                    continue
                mark = m[0][0]
                if mark not in " \t\r\n":
                    r.take(mark if mark in "[]{}:," else "a", at, m.end())
                at = m.end()
        found += r.whole
    out, behind = [], 0
    for begin, end in sorted(found, key=lambda s: (s[0], -s[1])):
        if begin >= behind:
            out.append((begin, end))
            behind = end
    return out


def canonical(array: str) -> str:
    """The published form: keys in order, no white space, characters as they are. Half of a surrogate pair stays an escape."""
    form = json.dumps(json.loads(array), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", form)


@F.pandas_udf(ArrayType(StringType()))
def json_arrays(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield part.map(lambda t: [canonical(t[a:b]) for a, b in array_spans(t)] if t else [])


def candidates(df: DataFrame, keys: list[str], order: list[str], text: Column, accepted) -> DataFrame:
    """keys, order, position, candidate, ok and chosen: of each key the first accepted array by order and position is
    chosen, the other rows are what a quarantine holds. accepted: a function from the array's Column to a Boolean."""
    found = df.select(*keys, *order, F.posexplode(json_arrays(text)).alias("position", "candidate"))
    found = found.withColumn("ok", F.coalesce(accepted(F.col("candidate")), F.lit(False)))
    w = Window.partitionBy(*keys).orderBy(F.desc("ok"), *order, "position")
    return found.withColumn("chosen", F.col("ok") & (F.row_number().over(w) == 1))


#: Order of the streams of an attempt; any other stream comes after them, by name.
STREAMS = ["stdout", "stderr", "response"]


def repair(expected: DataFrame, existing: DataFrame, outputs: DataFrame, rules, schema: str, max_attempts: int = 3) -> tuple[DataFrame, DataFrame]:
    """Chunks repaired from what attempts gave back.

    expected: chunk, id. existing: chunk, json (what was published before). outputs: chunk, attempt (from 1), stream, text.
    schema: DDL of a record with a string `id`. rules: a function from the Column of an array of records to {code: Column of a Boolean}.

    A chunk that exists and meets the contract is attempt 0 of the stream `existing`. Otherwise the candidates of its attempts are tried by attempt,
    stream and position up to max_attempts, and the first that meets the contract is accepted; those tried before it are quarantined with the
    codes of the rules they break, those after it aren't looked at. Returns
    accepted: chunk, attempt, stream, position, candidate (all null for a chunk that is exhausted), tried, and
    quarantine: chunk, attempt, stream, position, candidate, codes.

    Codes: invalid_json, not_array, invalid_record (an element that is no such record), wrong_count, duplicate_id, malformed_id, wrong_id_set, then those of `rules`. A chunk is of
    bounded size, as its ids are brought together; outputs without an expected chunk aren't used."""
    if max_attempts < 1:
        raise ValueError("at least one attempt")
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, STREAMS)), F.col("stream")), F.lit(0)), F.lit(len(STREAMS) + 1))
    none = F.lit(None).cast("string")
    old = existing.where("json IS NOT NULL").select("chunk", F.lit(0).alias("attempt"), F.lit("existing").alias("stream"), F.lit(0).alias("position"), F.col("json").alias("candidate"))
    new = outputs.where(F.col("attempt").between(1, max_attempts)).select("chunk", F.col("attempt").cast("int"), F.coalesce("stream", F.lit("")).alias("stream"), F.posexplode(json_arrays(F.col("text"))).alias("position", "candidate"))
    ids = expected.groupBy("chunk").agg(F.array_sort(F.collect_list("id")).alias("_want"))
    tries = old.unionByName(new).join(ids, "chunk").withColumn("_records", F.from_json("candidate", f"array<struct<{schema}>>", {"mode": "PERMISSIVE"}))
    got = F.transform("_records", lambda r: r["id"])
    known = F.filter(got, lambda x: x.isNotNull())
    own = {
        "wrong_count": F.size("_records") == F.size("_want"),
        "duplicate_id": F.size(F.array_distinct(known)) == F.size(known),
        "malformed_id": F.forall(got, lambda x: x.isNotNull() & x.rlike(r"^W\d+$")),
        "wrong_id_set": F.array_sort(F.array_distinct(known)) == F.array_distinct("_want"),
    }
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in {**own, **rules(F.col("_records"))}.items()]
    records = F.coalesce(F.forall("_records", lambda r: r.isNotNull()), F.lit(False))
    shape = F.when(F.try_parse_json("candidate").isNull(), "invalid_json").when(~F.col("candidate").rlike(r"^\s*\["), "not_array").when(~records, "invalid_record")
    tries = tries.withColumn("_shape", shape).withColumn("codes", F.when(F.col("_shape").isNull(), F.array_compact(F.array(*broken))).otherwise(F.array("_shape"))).drop("_records", "_want", "_shape")
    w = Window.partitionBy("chunk").orderBy("attempt", rank, "stream", "position")
    good = F.size("codes") == 0
    tries = tries.withColumn("_good_before", F.coalesce(F.max(good.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("_good_before = 0")
    at = ["attempt", "stream", "position", "candidate"]
    done = tries.groupBy("chunk").agg(F.max(F.when(good, F.struct(*at))).alias("_a"), F.count("*").alias("tried"))
    accepted = ids.select("chunk").join(done, "chunk", "left").select("chunk", *[F.coalesce(F.col(f"_a.{c}"), none.cast("string" if c in ("stream", "candidate") else "int")).alias(c) for c in at], F.coalesce("tried", F.lit(0)).alias("tried"))
    return accepted, tries.where(~good).select("chunk", *at, "codes")
