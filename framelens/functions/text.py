"""Text, key and inverted-index expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row. A filter on it stays above it; pushed below a projection it would be computed again."""
    return df.withColumn(name, F.explode(F.array(value)))


def quoted(term: str) -> str:
    """A term as a pattern that matches itself."""
    return re.sub(r"([^\w\s])", r"\\\1", term)


def bounded_lexicon(text: Column, terms: list[str]) -> Column:
    """True where a term stands in text with no ASCII letter on either side, in any letter case."""
    alternatives = "|".join(map(quoted, terms))
    return text.rlike(rf"(?iu)(^|[^\p{{Alpha}}])({alternatives})([^\p{{Alpha}}]|$)")


def any_contains(text: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.lower(text).contains(t)
    return out


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_tags(html: Column) -> Column:
    return squeeze(F.regexp_replace(html, "<[^>]*>", " "))


def bare_doi(doi: Column) -> Column:
    return F.lower(F.replace(doi, F.lit("https://doi.org/"), F.lit("")))


def venue_key(venue: Column, own: Column) -> Column:
    """Normalised venue; rows without one are groups of their own."""
    clean = F.lower(squeeze(venue))
    return F.when(clean.isNull() | (clean == ""), F.concat(F.lit("__missing__:"), own.cast("string"))).otherwise(clean)


def surrogate(prefix: str, name: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.md5(F.trim(name)), 1, 16))


def truncated(text: Column, n: int) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def tagged(**fields: Column) -> Column:
    """`TAG value` for each non-empty field, joined by spaces."""
    return F.concat_ws(" ", *[F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{k.upper()} "), c)) for k, c in fields.items()])


def bound(value: Column, body) -> Column:
    """body(v) with v evaluated once: a column named inside a lambda would be evaluated for every element."""
    return F.transform(F.array(value), body)[0]


def inverted(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, index): JSON inverted index {token: [positions]} of the text split at white space. Each row by itself, without a
    shuffle: the words are sorted with their positions, and each run of a word is one entry."""
    # sort_array compares structs by itself; array_sort evaluates an expression for every comparison. No element is null
    z = F.sort_array(F.transform(F.split(squeeze(text), " "), lambda w, p: F.struct(w.alias("w"), p.alias("p"))))

    def entries(z: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(z) - 1), lambda k: (k == 0) | (F.get(z, k - 1)["w"] != z[k]["w"]))
        end = lambda s, i: F.coalesce(F.get(s, i + 1), F.size(z)) - 1
        return bound(starts, lambda s: F.transform(s, lambda at, i: F.struct(z[at]["w"].alias("w"), F.transform(F.sequence(at, end(s, i)), lambda k: z[k]["p"]).alias("p"))))

    return df.select(id_col, F.to_json(F.map_from_entries(bound(z, entries))).alias("index"))


def deinvert(index: Column) -> Column:
    """Text of a JSON inverted index. Negative positions are skipped; of tokens at one position the last wins; null if nothing is left."""
    entries = F.map_entries(F.from_json(index, "map<string,array<int>>"))
    flat = F.flatten(F.transform(entries, lambda e, n: F.transform(F.coalesce(e["value"], F.array().cast("array<int>")), lambda p: F.struct(p.alias("p"), n.alias("n"), e["key"].alias("w")))))

    def text(ordered: Column) -> Column:
        last = F.filter(ordered, lambda x, i: F.coalesce(F.get(ordered, i + 1)["p"] != x["p"], F.lit(True)))
        return F.array_join(F.transform(last, lambda x: x["w"]), " ")

    return F.nullif(bound(F.sort_array(F.filter(flat, lambda x: x["p"] >= 0)), text), F.lit(""))


def tokens(text: Column) -> Column:
    """Lower-case letter and digit runs, unstemmed."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def pg_array(a: Column) -> Column:
    """Array literal of PostgreSQL: elements in quotes, quotes and backslashes in them escaped, a null element as NULL."""
    item = lambda x: F.coalesce(F.concat(F.lit('"'), F.regexp_replace(x, r'(["\\])', r"\\$1"), F.lit('"')), F.lit("NULL"))
    return F.concat(F.lit("{"), F.array_join(F.transform(a, item), ","), F.lit("}"))


def packed_scores(scores: Column) -> Column:
    """Hex of floor(65535 x + 0.5) as little-endian unsigned 16-bit; null where a score is not a number in [0, 1]."""
    bad = F.exists(scores, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x > 1))
    word = F.transform(scores, lambda x: F.lpad(F.hex(F.floor(x.cast("double") * 65535.0 + 0.5).cast("long")), 4, "0"))
    return F.when(~bad, F.lower(F.array_join(F.transform(word, lambda h: F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2))), "")))


def prefixed(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """df with every column but the keys renamed."""
    return df.select(*keys, *[F.col(f"`{c}`").alias(f"{prefix}_{c}") for c in df.columns if c not in keys])


def canonical_json(members: dict) -> Column:
    """A JSON object with its names in order, without white space and without null members; characters stay as they are, but for quotes, backslashes and
    control characters. Members are strings, whole numbers, Booleans, arrays of them, or dicts like this one."""

    def struct(m: dict) -> Column:
        return F.struct(*[(struct(v) if isinstance(v, dict) else v).alias(n) for n, v in sorted(m.items())])

    out = F.to_json(struct(members))
    for code in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)):  # the hex digits of escapes in lower case
        out = F.regexp_replace(out, rf"(?<!\\)((?:\\\\)*)\\u{code:04X}", rf"$1\\u{code:04x}")
    return out
