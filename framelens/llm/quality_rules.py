"""Quality rules whose cutoffs are certified on labelled holdouts.

Base rules are fixed: a document fails with fewer than 50 words or with more than half of its words in
3-word windows that the document repeats. On top, each rule of RULES compares one ratio with a cutoff.

The cutoffs of all rules are tightened together, in LEVELS steps from what hardly any text reaches to what clean texts
seldom pass. In each stratum (by default the language) the levels are tested from the loosest on: a level is certified if
the labelled good documents of the stratum show, by an exact binomial test, that it rejects at most ALPHA of them, by
whichever rule. The sequence stops at the first level that fails, which needs no correction within a stratum
(fixed-sequence testing); DELTA is divided by the strata that have enough labels to certify anything (Bonferroni). With
probability 1 - DELTA no stratum's level then rejects more than ALPHA of its good documents. A stratum with too few labels
gets no level and loses nothing but what fails the base rules.

Everything is DataFrame and SQL expressions. Windows are compared by 64-bit hashes within one document.

Defined cases: a null or empty text has no words and fails the base rules; null labels are ignored and a
document with several label rows is good only if all say so; a null stratum is a stratum of its own; an
empty label table certifies no cutoff; rows that repeat a doc_id get a row each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelens.llm.common import bound, join_small, written

ALPHA, DELTA = 0.05, 0.05
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Beyond so many repeated windows of one document they are found by sorting, not by look-up in a list.
FEW = 64

#: Rule: its ratio, high is bad, and its cutoffs at the loosest and the tightest level.
RULES: dict[str, tuple[str, float, float]] = {
    "symbols_per_word": ("n_symbols / n_words", 3.0, 0.05),
    "repeated_words": ("n_repeat_words / n_words", 0.9, 0.08),
    "repeated_lines": ("n_dup_lines / n_lines", 0.9, 0.1),
    "capitals": ("n_capitals / word_chars", 0.9, 0.04),
    "exclamations_per_word": ("n_exclamations / n_words", 3.0, 0.05),
    "word_length": ("word_chars / n_words", 15.0, 6.5),
}
LEVELS = 24


def cutoffs(rule: str) -> list[float]:
    """From the loosest to the tightest, each the same share of the one before."""
    _, loose, tight = RULES[rule]
    return [round(loose * (tight / loose) ** (t / (LEVELS - 1)), 4) for t in range(LEVELS)]


_SPACE = r"[\\x20\\x09-\\x0D]"
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_WINDOWS = "if(size(w) < 3, cast(array() as array<bigint>), transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])))"
_TWICE = bound("sort_array(t)", "array_distinct(filter(s, (x, k) -> k > 0 and get(s, k - 1) = x))", "s")
_BY_LIST = "filter(sequence(0, size(t) - 1), i -> array_contains(d, t[i]))"
_BY_SORT = bound("sort_array(transform(t, (h, i) -> struct(h, i)))", "transform(filter(z, (y, k) -> coalesce(get(z, k - 1).h = y.h, false) or coalesce(get(z, k + 1).h = y.h, false)), y -> y.i)", "z")
_COVERED = f"size(array_distinct(flatten(transform(if(size(d) <= {FEW}, {_BY_LIST}, {_BY_SORT}), p -> array(p, p + 1, p + 2)))))"
_REPEATED = bound(_WINDOWS, bound(_TWICE, f"if(size(d) = 0, 0, {_COVERED})", "d"), "t")
_WORDS = bound(
    f"if(trim(both {_WHITE} from t) = '', cast(array() as array<string>), split(trim(both {_WHITE} from t), '{_SPACE}+'))",
    f"named_struct('n_words', size(w), 'word_chars', char_length(array_join(w, '')), 'n_repeat_words', {_REPEATED})", "w",
)
_LINES = bound("split(t, '\\n', -1)", bound(f"filter(l, x -> trim(both {_WHITE} from x) <> '')", "named_struct('n_lines', size(l), 'n_dup_lines', size(f) - size(array_distinct(f)))", "f"), "l")


def base_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The other columns of docs under their names, then counts (long) of the text as columns of a struct _q."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    q = docs.withColumn("_t", t)
    text = lambda sql: F.expr(bound("_t", sql, "t"))
    q = q.withColumns({"_w": text(_WORDS), "_l": text(_LINES), "_s": F.regexp_count("_t", F.lit("[#*$%&|<>]")), "_c": F.regexp_count("_t", F.lit("[A-Z]")), "_e": F.regexp_count("_t", F.lit("!"))})
    parts = {"n_words": "_w.n_words", "word_chars": "_w.word_chars", "n_symbols": "_s", "n_dup_lines": "_l.n_dup_lines", "n_repeat_words": "_w.n_repeat_words", "n_lines": "_l.n_lines", "n_capitals": "_c", "n_exclamations": "_e"}
    return q.withColumn("_q", F.struct(*[F.col(c).cast("long").alias(n) for n, c in parts.items()])).drop("_t", "_w", "_l", "_s", "_c", "_e", text_col)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def ratio(rule: str) -> Column:
    top, below = RULES[rule][0].split(" / ")
    return F.coalesce(F.try_divide(F.col(top).cast("double"), F.col(below).cast("double")), F.lit(0.0))


def binomial_at_most(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), exact up to rounding: the term at k from logarithms, then the ratios of the terms below it."""
    log_k = F.aggregate(
        F.when(k > 0, F.sequence(F.lit(0), k.cast("int") - 1)).otherwise(F.array().cast("array<int>")),
        F.log1p(F.lit(-p)) * (n - k) + F.log(F.lit(p)) * k,
        lambda s, i: s + F.log((n - i) / (i + 1.0)),
    )
    down = F.aggregate(
        F.when(k > 0, F.sequence(k.cast("int"), F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda s, i: F.struct((s["term"] * i * ((1 - p) / p) / (n - i + 1.0)).alias("term"), (s["sum"] + s["term"] * i * ((1 - p) / p) / (n - i + 1.0)).alias("sum")),
    )["sum"]
    # k at or above n p rejects nothing; there the ratios grow and the sum isn't needed
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(log_k) * down)


def within() -> Column:
    """How many levels, from the loosest on, a document passes by all rules."""

    def by(rule: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, cutoffs(rule))), lambda c: ratio(rule) <= c))

    return F.least(*map(by, RULES))


def certified_levels(good: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """good: _stratum and _within (levels passed) of labelled good documents that pass the base rules.
    Returns _stratum, _level (from 0, null if none is certified), labels and rejected (at that level): a row for each labelled stratum."""
    hist = written(good.groupBy("_stratum", "_within").agg(F.count("*").alias("n")), "quality-levels")  # strata x levels rows
    total = hist.groupBy("_stratum").agg(F.sum("n").alias("labels"), F.collect_list(F.struct("_within", "n")).alias("h"))
    # with fewer labels not even a level that rejects none of them could be certified
    able = total.where(F.col("labels") >= math.log(min(delta, 1 - 1e-9)) / math.log(1 - alpha)).count()
    tested = total.select("_stratum", "labels", "h", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("at")).withColumn(
        "rejected", F.aggregate(F.filter("h", lambda x: x["_within"] <= F.col("at")), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    )
    tested = tested.withColumn("ok", binomial_at_most(F.col("rejected"), F.col("labels"), alpha) <= delta / max(able, 1))
    w = Window.partitionBy("_stratum").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    kept = tested.withColumn("ok", F.min("ok").over(w)).groupBy("_stratum", "labels").agg(F.max(F.when(F.col("ok"), F.struct("at", "rejected"))).alias("best"))
    return kept.select("_stratum", F.col("best.at").alias("_level"), "labels", F.col("best.rejected").alias("rejected"))


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """id, stratum, the counts, base_failed, kept and failed_rules for each row of docs.
    labels: id_col, quality (1 good, 0 bad)."""
    src = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("\u0000null")).alias("_stratum"), F.col(text_col).alias("_text"))
    feats = written(base_features(src, "_text").select("_id", "_stratum", "_q.*").withColumn("base_failed", base_failed()), "quality-counts")
    good = labels.where(F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min("quality").alias("g")).where("g = 1").select("_id")
    levels = written(certified_levels(feats.where(~F.col("base_failed")).join(good, "_id", "left_semi").select("_stratum", within().alias("_within")), alpha, delta), "quality-cutoffs")
    out = join_small(feats, levels.select("_stratum", "_level"), "_stratum", "left", rows=100_000)
    cut = lambda r: F.get(F.array(*map(F.lit, cutoffs(r))), F.col("_level"))
    failed = F.array_compact(F.array(*[F.when(ratio(r) > cut(r), F.lit(r)) for r in RULES]))
    return out.withColumn("failed_rules", F.coalesce(failed, F.array().cast("array<string>"))).select(
        F.col("_id").alias(id_col), F.nullif("_stratum", F.lit("\u0000null")).alias(stratum_col),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_exclamations", "base_failed",
        (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), "failed_rules",
    )
