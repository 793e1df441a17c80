"""Agreement of label arms, design weights and tests: documents' labels against a second arm made from hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelens.operators import stats
from framelens.session import table

CATS = ("quality", "toxic")


def arms(spark, d):
    """(doc_id, lang, w, arm a: quality and toxic, arm b: the same, some flipped by md5 or unknown)."""
    h = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1)
    lab = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    docs = table(spark, d, "documents").select("doc_id", "lang", (1.0 + F.col("doc_id") % 4).alias("w"))
    out = lab.join(docs, "doc_id")
    q = F.when(h != "f", F.when(h < "3", 1 - F.col("quality")).otherwise(F.col("quality")))
    t = F.when(h != "f", F.when(h > "c", 1 - F.col("toxic")).otherwise(F.col("toxic")))
    return out.select("doc_id", "lang", "w", F.col("quality").alias("a_quality"), F.col("toxic").alias("a_toxic"), q.alias("b_quality"), t.alias("b_toxic"))


def _rows(spark, d):
    """A row for each document and category that both arms know."""
    x = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), (F.col(f"a_{c}") == 1).alias("a"), (F.col(f"b_{c}") == 1).alias("b")) for c in CATS]))
    return arms(spark, d).select("doc_id", "lang", "w", x.alias("x")).select("doc_id", "lang", "w", "x.*").where("b IS NOT NULL")


def _jaccard(g):
    both, either = F.col("a") & F.col("b"), F.col("a") | F.col("b")
    m = g.agg(F.count_if(both).alias("n_both"), F.count_if(either).alias("n_either"), F.sum(F.when(both, F.col("w")).otherwise(0.0)).alias("wb"), F.sum(F.when(either, F.col("w")).otherwise(0.0)).alias("we"))
    r = lambda x, y: F.round(F.when(F.col(y) == 0, 1.0).otherwise(F.try_divide(x, y)), 6)
    return m.withColumns({"jaccard": r("n_both", "n_either"), "weighted": r("wb", "we")}).drop("wb", "we")


def jaccard_pairs(spark, d):
    return _jaccard(_rows(spark, d).groupBy("category"))


def jaccard_by_stratum(spark, d):
    return _jaccard(_rows(spark, d).groupBy("category", "lang"))


def two_arm_report(spark, d):
    """Any category defined in either arm, and exact equality of the sets of categories."""
    r = _rows(spark, d).groupBy("doc_id").agg(F.max("a").alias("a"), F.max("b").alias("b"), F.first("w").alias("w"), F.min(F.col("a") == F.col("b")).alias("same"))
    return r.agg(F.count_if("a").alias("any_a"), F.count_if("b").alias("any_b"), F.count_if(F.col("a") & F.col("b")).alias("n_both"), F.count_if("same").alias("same_set"), F.round(F.sum(F.when(F.col("same"), F.col("w")).otherwise(0.0)) / F.sum("w"), 6).alias("same_weighted"))


def kappa_by_category(spark, d):
    r = _rows(spark, d).groupBy("category").agg(F.count("*").cast("double").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("agree"), F.count_if("a").alias("pa"), F.count_if("b").alias("pb"))
    e = F.col("pa") * F.col("pb") + (F.col("n") - F.col("pa")) * (F.col("n") - F.col("pb"))
    return r.select("category", F.round(stats.kappa(F.col("agree"), e, F.col("n")), 6).alias("kappa"))


def agreement_by_stratum(spark, d):
    g = _rows(spark, d).groupBy("lang", "category").agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("agree"), F.count_if("a").alias("pos_a"), F.count_if("b").alias("pos_b"))
    return g.withColumn("pct", F.round(100.0 * F.col("agree") / F.col("n"), 1))


def crosstab(spark, d):
    return arms(spark, d).groupBy("a_quality", "b_quality").agg(F.count("*").alias("n"))


def vote_consensus(spark, d):
    """Votes of three arms: unanimous, majority, any."""
    v = arms(spark, d).select(F.coalesce("a_quality", F.lit(0)).alias("x"), F.coalesce("b_quality", F.lit(0)).alias("y"), (1 - F.col("a_toxic")).alias("z"))
    s = F.col("x") + F.col("y") + F.col("z")
    return v.agg(F.count_if(s == 3).alias("unanimous"), F.count_if(s >= 2).alias("majority"), F.count_if(s >= 1).alias("any_arm"), F.count("*").alias("n"))


def pattern_counts(spark, d):
    """Sorted distinct types of each user, joined, and how many users have each pattern."""
    p = table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), "/").alias("pattern"))
    return p.groupBy("pattern").agg(F.count("*").alias("users"))


def transition_table(spark, d):
    """From arm a's state to arm b's, and those that became known to agree."""
    s = lambda c: F.when(F.col(c).isNull(), "unknown").when(F.col(c) == 1, "yes").otherwise("no")
    return arms(spark, d).groupBy(s("a_toxic").alias("before"), s("b_toxic").alias("after")).agg(F.count("*").alias("n"))


def weighted_rate(spark, d):
    """Design-weighted rate with its size on the frame, effective sample size and largest weight share."""
    g = arms(spark, d).groupBy("lang").agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sw2"), F.sum(F.col("w") * F.col("a_toxic")).alias("swv"), F.max("w").alias("mw"), F.count("*").alias("n"))
    return g.select("lang", "n", F.round(F.col("swv") / F.col("sw"), 6).alias("rate"), F.round(1000 * F.col("swv") / F.col("sw"), 3).alias("expected"), F.round(F.col("sw") * F.col("sw") / F.col("sw2"), 6).alias("ess"), F.round(F.col("mw") / F.col("sw"), 6).alias("top_share"))


def support_gate(spark, d):
    """Available only with 25 known positives and 25 known negatives; unknown counts for neither."""
    x = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"b_{c}").alias("v")) for c in CATS]))
    g = arms(spark, d).select("lang", x.alias("x")).groupBy("lang", "x.category").agg(F.count_if(F.col("x.v") == 1).alias("pos"), F.count_if(F.col("x.v") == 0).alias("neg"), F.count_if(F.col("x.v").isNull()).alias("unknown"))
    return g.withColumn("available", (F.col("pos") >= 25) & (F.col("neg") >= 25))


def head_gate(spark, d):
    """A head is hard if both arms have 20 positives and an effective size of 10."""
    x = F.explode(F.array(*[F.struct(F.lit(c).alias("head"), F.lit(a).alias("arm"), F.col(f"{a}_{c}").alias("v")) for c in CATS for a in "ab"]))
    g = arms(spark, d).select("w", x.alias("x")).where("x.v = 1").groupBy("x.head", "x.arm").agg(F.count("*").alias("n"), (F.sum("w") * F.sum("w") / F.sum(F.col("w") * F.col("w"))).alias("ess"))
    return g.groupBy("head").agg(F.count("*").alias("arms"), F.min("n").alias("least"), F.bool_and((F.col("n") >= 20) & (F.col("ess") >= 10)).alias("hard"))


def recall_route(spark, d):
    """A route's recall and precision against a reference; rows with an unknown reference are no data."""
    g = arms(spark, d).where("b_toxic IS NOT NULL").groupBy("lang").agg(*[F.count_if((F.col("a_toxic") == x) & (F.col("b_toxic") == y)).alias(n) for n, x, y in (("tp", 1, 1), ("fp", 1, 0), ("fn", 0, 1), ("tn", 0, 0))])
    return g.select("*", F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6).alias("recall"), F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6).alias("precision"))


def recall_intervals(spark, d):
    """Exact intervals for the recall of recall_route."""
    g = recall_route(spark, d).select("lang", "tp", (F.col("tp") + F.col("fn")).alias("n"))
    return g.withColumn("ci", stats.clopper_pearson("tp", "n")).select("lang", "tp", "n", F.round("ci.low", 6).alias("low"), F.round("ci.high", 6).alias("high"))


def recall_adjusted(spark, d):
    """Recall over all reference positives and over those that could be claimed."""
    ref = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    claim = table(spark, d, "documents").where("n_chars > 300").select("doc_id", "lang")
    found = claim.where("lang = 'en'").select("doc_id", F.lit(True).alias("found"))
    j = ref.join(claim.select("doc_id", F.lit(True).alias("claimable")), "doc_id", "left").join(found, "doc_id", "left")
    g = j.agg(F.count("*").alias("reference"), F.count("claimable").alias("claimable"), F.count("found").alias("found"))
    return g.select("*", F.round(F.try_divide("found", "reference"), 6).alias("naive"), F.round(F.try_divide("found", "claimable"), 6).alias("adjusted"))


def judge_bias(spark, d):
    a = arms(spark, d).where("b_quality IS NOT NULL AND a_quality <> b_quality").withColumn("judge", 1 - F.col("a_toxic"))
    return a.agg(F.count("*").alias("contested"), F.count_if(F.col("judge") == F.col("a_quality")).alias("with_a"), F.count_if(F.col("judge") == F.col("b_quality")).alias("with_b"))


def chisq_stat(spark, d):
    """2 x 2 statistic with and without Yates' correction."""
    g = arms(spark, d).agg(*[F.count_if((F.col("a_quality") == x) & (F.col("a_toxic") == y)).cast("double").alias(n) for n, x, y in (("a", 1, 1), ("b", 1, 0), ("c", 0, 1), ("e", 0, 0))])
    n, det = F.col("a") + F.col("b") + F.col("c") + F.col("e"), F.abs(F.col("a") * F.col("e") - F.col("b") * F.col("c"))
    below = (F.col("a") + F.col("b")) * (F.col("c") + F.col("e")) * (F.col("a") + F.col("c")) * (F.col("b") + F.col("e"))
    yates = F.greatest(F.lit(0.0), det - n / 2)
    return g.select("a", "b", "c", "e", F.round(F.try_divide(n * det * det, below), 6).alias("plain"), F.round(F.try_divide(n * yates * yates, below), 6).alias("yates"))


def cmh_stat(spark, d):
    """Mantel-Haenszel odds ratio and statistic over languages."""
    g = arms(spark, d).groupBy("lang").agg(*[F.count_if((F.col("a_quality") == x) & (F.col("a_toxic") == y)).cast("double").alias(n) for n, x, y in (("a", 1, 1), ("b", 1, 0), ("c", 0, 1), ("e", 0, 0))])
    g = g.withColumn("n", F.col("a") + F.col("b") + F.col("c") + F.col("e")).where("n > 1")
    r1, c1 = F.col("a") + F.col("b"), F.col("a") + F.col("c")
    m = g.agg(F.sum("a").alias("sa"), F.sum(r1 * c1 / F.col("n")).alias("se"), F.sum(r1 * (F.col("n") - r1) * c1 * (F.col("n") - c1) / (F.col("n") * F.col("n") * (F.col("n") - 1))).alias("v"), F.sum(F.col("a") * F.col("e") / F.col("n")).alias("up"), F.sum(F.col("b") * F.col("c") / F.col("n")).alias("down"))
    return m.select(F.round(F.try_divide("up", "down"), 6).alias("odds"), F.round(F.try_divide(F.pow(F.abs(F.col("sa") - F.col("se")) - 0.5, F.lit(2.0)), "v"), 6).alias("statistic"))


def log_odds(spark, d):
    """One binary predictor: log odds ratio and its Wald error in closed form."""
    g = arms(spark, d).agg(*[(F.count_if((F.col("a_quality") == x) & (F.col("a_toxic") == y)) + 0.5).cast("double").alias(n) for n, x, y in (("a", 1, 1), ("b", 1, 0), ("c", 0, 1), ("e", 0, 0))])
    return g.select(F.round(F.log(F.col("a") * F.col("e") / (F.col("b") * F.col("c"))), 6).alias("log_or"), F.round(F.sqrt(1 / F.col("a") + 1 / F.col("b") + 1 / F.col("c") + 1 / F.col("e")), 6).alias("se"))


def audit_power(spark, d):
    """Expected hits over a grid of recalls from the observed base rate."""
    g = arms(spark, d).agg(F.avg(F.col("a_toxic").cast("double")).alias("rate"))
    grid = F.explode(F.array(*[F.lit(x) for x in (0.5, 0.7, 0.8, 0.9, 0.95)]))
    return g.select("rate", grid.alias("recall")).select("recall", F.round(1000 * F.col("rate") * F.col("recall"), 6).alias("hits"), F.ceil(F.round(10 / (F.col("rate") * (1.05 - F.col("recall"))), 6)).cast("long").alias("needed"))


def cost_model(spark, d):
    """Tokens by four characters, prices a million, the prompt shared by 25 rows."""
    g = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.ceil(F.col("n_chars") / 4)).alias("tokens"))
    return g.select("lang", "n", "tokens", F.round((F.col("tokens") * 3.0 + F.ceil(F.col("n") / 25) * 1200 * 0.3) / 1e6, 6).alias("cost"))


def loss_bias(spark, d):
    """Share of a missing covariate among rows lost and kept."""
    lab = table(spark, d, "labels").select("doc_id").distinct().withColumn("kept", F.lit(True))
    j = table(spark, d, "documents").select("doc_id", (F.col("n_chars") < 500).alias("thin")).join(lab, "doc_id", "left")
    return j.groupBy(F.coalesce("kept", F.lit(False)).alias("kept")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("thin").cast("double")), 6).alias("share"))


_H = "substr(md5(CAST(doc_id AS VARCHAR)), 1, 1)"
_A = f"arms AS (SELECT doc_id, lang, 1.0::DOUBLE + doc_id % 4 AS w, quality AS a_quality, toxic AS a_toxic, CASE WHEN {_H} <> 'f' THEN CASE WHEN {_H} < '3' THEN 1 - quality ELSE quality END END AS b_quality, CASE WHEN {_H} <> 'f' THEN CASE WHEN {_H} > 'c' THEN 1 - toxic ELSE toxic END END AS b_toxic FROM labels JOIN documents USING (doc_id))"
_RW = f"{_A}, r AS (SELECT doc_id, lang, w, 'quality' AS category, a_quality = 1 AS a, b_quality = 1 AS b FROM arms WHERE b_quality IS NOT NULL UNION ALL SELECT doc_id, lang, w, 'toxic', a_toxic = 1, b_toxic = 1 FROM arms WHERE b_toxic IS NOT NULL)"
_J = "count(*) FILTER (WHERE a AND b) AS n_both, count(*) FILTER (WHERE a OR b) AS n_either, round(CASE WHEN count(*) FILTER (WHERE a OR b) = 0 THEN 1 ELSE count(*) FILTER (WHERE a AND b)::DOUBLE / count(*) FILTER (WHERE a OR b) END, 6) AS jaccard, round(CASE WHEN coalesce(sum(w) FILTER (WHERE a OR b), 0) = 0 THEN 1 ELSE coalesce(sum(w) FILTER (WHERE a AND b), 0) / sum(w) FILTER (WHERE a OR b) END, 6) AS weighted"
_ST = lambda c: f"CASE WHEN {c} IS NULL THEN 'unknown' WHEN {c} = 1 THEN 'yes' ELSE 'no' END"
_T = "count(*) FILTER (WHERE a_quality = 1 AND a_toxic = 1)::DOUBLE{0} AS a, count(*) FILTER (WHERE a_quality = 1 AND a_toxic = 0)::DOUBLE{0} AS b, count(*) FILTER (WHERE a_quality = 0 AND a_toxic = 1)::DOUBLE{0} AS c, count(*) FILTER (WHERE a_quality = 0 AND a_toxic = 0)::DOUBLE{0} AS e"
_LONG = f"{_A}, x AS (SELECT lang, w, 'quality' AS category, 'a' AS arm, a_quality AS v FROM arms UNION ALL SELECT lang, w, 'toxic', 'a', a_toxic FROM arms UNION ALL SELECT lang, w, 'quality', 'b', b_quality FROM arms UNION ALL SELECT lang, w, 'toxic', 'b', b_toxic FROM arms)"
QUERIES = {f.__name__: f for f in (jaccard_pairs, jaccard_by_stratum, two_arm_report, kappa_by_category, agreement_by_stratum, crosstab, vote_consensus, pattern_counts, transition_table, weighted_rate, support_gate, head_gate, recall_route, recall_intervals, recall_adjusted, judge_bias, chisq_stat, cmh_stat, log_odds, audit_power, cost_model, loss_bias)}
ORACLE = {
    "jaccard_pairs": f"WITH {_RW} SELECT category, {_J} FROM r GROUP BY 1",
    "jaccard_by_stratum": f"WITH {_RW} SELECT category, lang, {_J} FROM r GROUP BY 1, 2",
    "two_arm_report": f"WITH {_RW}, g AS (SELECT doc_id, bool_or(a) AS a, bool_or(b) AS b, max(w) AS w, bool_and(a = b) AS same FROM r GROUP BY 1) SELECT count(*) FILTER (WHERE a) AS any_a, count(*) FILTER (WHERE b) AS any_b, count(*) FILTER (WHERE a AND b) AS n_both, count(*) FILTER (WHERE same) AS same_set, round(coalesce(sum(w) FILTER (WHERE same), 0) / sum(w), 6) AS same_weighted FROM g",
    "kappa_by_category": f"WITH {_RW}, g AS (SELECT category, count(*)::DOUBLE AS n, count(*) FILTER (WHERE a = b) AS agree, count(*) FILTER (WHERE a) AS pa, count(*) FILTER (WHERE b) AS pb FROM r GROUP BY 1), k AS (SELECT category, agree / n AS po, (pa * pb + (n - pa) * (n - pb)) / (n * n) AS pe FROM g) SELECT category, round(CASE WHEN pe <> 1 THEN (po - pe) / (1 - pe) END, 6) AS kappa FROM k",
    "agreement_by_stratum": f"WITH {_RW} SELECT lang, category, count(*) AS n, count(*) FILTER (WHERE a = b) AS agree, count(*) FILTER (WHERE a) AS pos_a, count(*) FILTER (WHERE b) AS pos_b, round(100.0::DOUBLE * count(*) FILTER (WHERE a = b) / count(*), 1) AS pct FROM r GROUP BY 1, 2",
    "crosstab": f"WITH {_A} SELECT a_quality, b_quality, count(*) AS n FROM arms GROUP BY 1, 2",
    "vote_consensus": f"WITH {_A}, v AS (SELECT coalesce(a_quality, 0) + coalesce(b_quality, 0) + 1 - a_toxic AS s FROM arms) SELECT count(*) FILTER (WHERE s = 3) AS unanimous, count(*) FILTER (WHERE s >= 2) AS majority, count(*) FILTER (WHERE s >= 1) AS any_arm, count(*) AS n FROM v",
    "pattern_counts": "SELECT pattern, count(*) AS users FROM (SELECT user_id, string_agg(DISTINCT event_type, '/' ORDER BY event_type) AS pattern FROM events GROUP BY 1) GROUP BY 1",
    "transition_table": f"WITH {_A} SELECT {_ST('a_toxic')} AS before, {_ST('b_toxic')} AS after, count(*) AS n FROM arms GROUP BY 1, 2",
    "weighted_rate": f"WITH {_A} SELECT lang, count(*) AS n, round(sum(w * a_toxic) / sum(w), 6) AS rate, round(1000 * sum(w * a_toxic) / sum(w), 3) AS expected, round(sum(w) * sum(w) / sum(w * w), 6) AS ess, round(max(w) / sum(w), 6) AS top_share FROM arms GROUP BY 1",
    "support_gate": f"WITH {_LONG}, g AS (SELECT lang, category, count(*) FILTER (WHERE v = 1) AS pos, count(*) FILTER (WHERE v = 0) AS neg, count(*) FILTER (WHERE v IS NULL) AS unknown FROM x WHERE arm = 'b' GROUP BY 1, 2) SELECT *, pos >= 25 AND neg >= 25 AS available FROM g",
    "head_gate": f"WITH {_LONG}, g AS (SELECT category AS head, arm, count(*) AS n, sum(w) * sum(w) / sum(w * w) AS ess FROM x WHERE v = 1 GROUP BY 1, 2) SELECT head, count(*) AS arms, min(n) AS least, bool_and(n >= 20 AND ess >= 10) AS hard FROM g GROUP BY 1",
    "recall_route": f"WITH {_A}, g AS (SELECT lang, count(*) FILTER (WHERE a_toxic = 1 AND b_toxic = 1) AS tp, count(*) FILTER (WHERE a_toxic = 1 AND b_toxic = 0) AS fp, count(*) FILTER (WHERE a_toxic = 0 AND b_toxic = 1) AS fn, count(*) FILTER (WHERE a_toxic = 0 AND b_toxic = 0) AS tn FROM arms WHERE b_toxic IS NOT NULL GROUP BY 1) SELECT *, round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS recall, round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS precision FROM g",
    "recall_adjusted": "WITH g AS (SELECT count(*) AS reference, count(d.doc_id) AS claimable, count(*) FILTER (WHERE d.lang = 'en') AS found FROM labels l LEFT JOIN (SELECT * FROM documents WHERE n_chars > 300) d USING (doc_id) WHERE toxic = 1) SELECT *, round(found::DOUBLE / nullif(reference, 0), 6) AS naive, round(found::DOUBLE / nullif(claimable, 0), 6) AS adjusted FROM g",
    "judge_bias": f"WITH {_A} SELECT count(*) AS contested, count(*) FILTER (WHERE 1 - a_toxic = a_quality) AS with_a, count(*) FILTER (WHERE 1 - a_toxic = b_quality) AS with_b FROM arms WHERE b_quality IS NOT NULL AND a_quality <> b_quality",
    "chisq_stat": f"WITH {_A}, t AS (SELECT {_T.format('')} FROM arms), m AS (SELECT *, a + b + c + e AS n, abs(a * e - b * c) AS det, (a + b) * (c + e) * (a + c) * (b + e) AS below FROM t) SELECT a, b, c, e, round(n * det * det / nullif(below, 0), 6) AS plain, round(n * power(greatest(0, det - n / 2), 2) / nullif(below, 0), 6) AS yates FROM m",
    "cmh_stat": f"WITH {_A}, t AS (SELECT lang, {_T.format('')} FROM arms GROUP BY 1), g AS (SELECT *, a + b + c + e AS n, a + b AS r1, a + c AS c1 FROM t), m AS (SELECT sum(a) AS sa, sum(r1 * c1 / n) AS se, sum(r1 * (n - r1) * c1 * (n - c1) / (n * n * (n - 1))) AS v, sum(a * e / n) AS up, sum(b * c / n) AS down FROM g WHERE n > 1) SELECT round(up / nullif(down, 0), 6) AS odds, round(power(abs(sa - se) - 0.5::DOUBLE, 2) / nullif(v, 0), 6) AS statistic FROM m",
    "log_odds": f"WITH {_A}, t AS (SELECT {_T.format(' + 0.5::DOUBLE')} FROM arms) SELECT round(ln(a * e / (b * c)), 6) AS log_or, round(sqrt(1 / a + 1 / b + 1 / c + 1 / e), 6) AS se FROM t",
    "audit_power": f"WITH {_A}, g AS (SELECT avg(CAST(a_toxic AS DOUBLE)) AS rate FROM arms) SELECT recall, round(1000 * rate * recall, 6) AS hits, CAST(ceil(round(10 / (rate * (1.05::DOUBLE - recall)), 6)) AS BIGINT) AS needed FROM g, (SELECT unnest([0.5::DOUBLE, 0.7::DOUBLE, 0.8::DOUBLE, 0.9::DOUBLE, 0.95::DOUBLE]) AS recall)",
    "cost_model": "SELECT lang, n, tokens, round((tokens * 3.0::DOUBLE + ceil(n / 25.0::DOUBLE) * 1200 * 0.3::DOUBLE) / 1e6::DOUBLE, 6) AS cost FROM (SELECT lang, count(*) AS n, CAST(sum(ceil(n_chars / 4.0::DOUBLE)) AS BIGINT) AS tokens FROM documents GROUP BY 1)",
    "loss_bias": "SELECT l.doc_id IS NOT NULL AS kept, count(*) AS n, round(avg(CAST(n_chars < 500 AS DOUBLE)), 6) AS share FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1",
}
