"""Thresholds, curves, quotas and fusion on embeddings: two arms with three heads each."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelens.operators import scores as S
from framelens.session import table

HEADS, RATE = 3, 0.1


def _e(i):
    return F.round(F.element_at("embedding", i).cast("double"), 2)


def long_scores(spark, d):
    """(vec_id, arm, head, score, positive, weight): scores of two places, so that ties occur."""
    e = table(spark, d, "embeddings")
    x = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(h).alias("head"), _e(1 + HEADS * i + h).alias("score"), (F.col("label") == h).alias("positive")) for i, a in enumerate(("a", "b")) for h in range(HEADS)]))
    return e.select("vec_id", (1.0 + F.col("vec_id") % 3).alias("weight"), x.alias("x")).select("vec_id", "weight", "x.*")


def _w():
    return F.col("weight")


def weighted_confusion(spark, d):
    s = long_scores(spark, d).groupBy("arm", "head").agg(*S.confusion(F.col("positive"), F.col("score") > 0, _w()))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return s.select("arm", "head", "tp", "fp", "fn", "tn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.try_divide(5.0 * F.col("tp"), 5.0 * F.col("tp") + 4.0 * F.col("fn") + F.col("fp")), 6).alias("f2"))


def fbeta_threshold(spark, d):
    out = S.best_threshold(long_scores(spark, d), "score", F.col("positive"), _w(), 1.0, False, ["arm", "head"])
    return out.select("arm", "head", F.round("threshold", 6).alias("threshold"), F.round("f", 6).alias("f"))


def f2_low_tie(spark, d):
    out = S.best_threshold(long_scores(spark, d), "score", F.col("positive"), _w(), 2.0, True, ["arm", "head"])
    return out.select("arm", "head", F.round("threshold", 6).alias("threshold"), F.round("f", 6).alias("f"))


def crossfit_f2(spark, d):
    """Threshold from the other folds, measured on the fold held out."""
    s = long_scores(spark, d).withColumn("fold", (F.col("vec_id") % 3).cast("int"))
    other = s.select("*", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("k")).where("fold <> k")
    t = S.best_threshold(other, "score", F.col("positive"), _w(), 2.0, True, ["arm", "head", "k"]).withColumnRenamed("k", "fold")
    m = s.join(t.select("arm", "head", "fold", "threshold"), ["arm", "head", "fold"]).groupBy("arm", "head", "fold").agg(F.first("threshold").alias("threshold"), *S.confusion(F.col("positive"), F.col("score") >= F.col("threshold"), _w()))
    return m.select("arm", "head", "fold", F.round("threshold", 6).alias("threshold"), "tp", "fp", "fn", "tn")


def average_precision(spark, d):
    return S.average_precision(long_scores(spark, d), "score", F.col("positive"), _w(), ["arm", "head"]).select("arm", "head", F.round("ap", 6).alias("ap"))


def roc_auc_midrank(spark, d):
    return S.midrank_auc(long_scores(spark, d), "score", F.col("positive"), _w(), ["arm", "head"]).select("arm", "head", F.round("auc", 6).alias("auc"))


def top_decile_lift(spark, d):
    """Rate of positives among the first tenth (rounded down, at least one row) over the rate of all."""
    x = long_scores(spark, d)
    g = S.first_rows(x, "score", "vec_id", lambda n: F.greatest(F.lit(1), F.floor(n / 10)), ["arm", "head"]).groupBy("arm", "head").agg(F.count_if("flag").alias("n"), F.count_if(F.col("flag") & F.col("positive")).alias("hits"), F.avg(F.col("positive").cast("double")).alias("base"))
    return g.select("arm", "head", "n", "hits", F.round(F.try_divide(F.col("hits") / F.col("n"), F.col("base")), 6).alias("lift"))


def cut_at_n(spark, d):
    """Threshold at the 25th highest score, ties kept."""
    t = S.steps(long_scores(spark, d), "score", F.lit(True), F.lit(1.0), ["arm", "head"]).where(F.col("cum") - F.col("ga") < 25)
    return t.groupBy("arm", "head").agg(F.min("score").alias("threshold"), F.max("cum").cast("long").alias("kept"))


def auc_without_ties(spark, d):
    """Pairs in which the positive is strictly above, over all pairs: no credit for ties."""
    s = S.steps(long_scores(spark, d), "score", F.col("positive"), F.lit(1.0), ["arm", "head"])
    g = s.groupBy("arm", "head").agg(F.sum("gp").alias("p"), F.sum(F.col("ga") - F.col("gp")).alias("n"))
    below = F.col("n") - (F.col("cum") - F.col("tp"))
    return s.join(g, ["arm", "head"]).groupBy("arm", "head").agg(F.round(F.try_divide(F.sum(F.col("gp") * below), F.first("p") * F.first("n")), 6).alias("auc"))


def quota_topk(spark, d):
    return S.quota_flags(long_scores(spark, d), "score", "vec_id", RATE, ["arm", "head"]).where("flag").select("vec_id", "arm", "head")


def hybrid_fusion(spark, d):
    """Candidate is the union of the arms' quotas, consensus the intersection; heads disagree by their spread."""
    f = S.quota_flags(long_scores(spark, d), "score", "vec_id", RATE, ["arm", "head"])
    p = f.groupBy("vec_id", "head").agg(F.max("flag").alias("candidate"), F.min("flag").alias("consensus"), (F.max("score") - F.min("score")).alias("spread"))
    name = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(F.col(c), F.concat(F.lit("h"), F.col("head").cast("string"))))), ",")
    return p.groupBy("vec_id").agg(name("candidate").alias("candidates"), name("consensus").alias("consensus"), F.round(F.max("spread"), 6).alias("spread_max"))


def uncertainty_max(spark, d):
    """1 - |s - t| / scale of the head's cut, clipped to [0, 1], 0 for no scale; the largest over heads."""
    s = long_scores(spark, d).withColumn("t", F.lit(0.3))
    scale = F.when(F.col("score") < F.col("t"), F.col("t")).otherwise(1.0 - F.col("t"))
    u = F.when(scale <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.abs(F.col("score") - F.col("t")) / scale)))
    return s.groupBy("vec_id").agg(F.round(F.max(u), 6).alias("uncertainty"))


def categorical_argmax(spark, d):
    """Winner of the mean of two vectors, first of equals; whether the arms agree; their largest difference."""
    e = table(spark, d, "embeddings").select("vec_id", *[F.transform(F.slice("embedding", 1 + 4 * i, 4), lambda x: F.round(x.cast("double"), 4)).alias(n) for i, n in enumerate("ab")])
    at = lambda c: F.array_position(c, F.array_max(c)).cast("int")
    e = e.withColumns({"m": F.zip_with("a", "b", lambda x, y: (x + y) / 2), "diff": F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x - y)))})
    return e.select("vec_id", at(F.col("m")).alias("winner"), (at(F.col("a")) == at(F.col("b"))).alias("agree"), F.round("diff", 4).alias("max_diff"))


def decision_nulls(spark, d):
    """Decisions of two arms are unknown where either is, unlike a plain OR."""
    e = table(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 5 != 0, _e(1) > 0).alias("a"), F.when(F.col("vec_id") % 7 != 0, _e(2) > 0).alias("b"))
    known = F.col("a").isNotNull() & F.col("b").isNotNull()
    return e.groupBy(F.when(known, F.col("a") | F.col("b")).alias("candidate"), F.when(known, F.col("a") & F.col("b")).alias("consensus")).agg(F.count("*").alias("n"))


def _rounds(spark, d):
    e = table(spark, d, "events").select(F.dayofmonth("ts").alias("round"), "user_id", "value").where("round <= 8")
    return e.groupBy("round", "user_id").agg(F.round(F.sum("value"), 4).alias("v"))


def round_churn(spark, d):
    """Share of ids that came or went since the round before."""
    r = _rounds(spark, d).select("round", "user_id")
    back = r.select((F.col("round") + 1).alias("round"), "user_id", F.lit(1).alias("was"))
    j = r.withColumn("now", F.lit(1)).join(back, ["round", "user_id"], "outer").where(F.col("round").between(2, 8))
    g = j.groupBy("round").agg(F.count_if(F.col("now").isNull() | F.col("was").isNull()).alias("changed"), F.count("*").alias("either"))
    return g.select("round", "changed", "either", F.round(F.col("changed") / F.greatest("either", F.lit(1)), 6).alias("churn"))


def round_gate(spark, d):
    """Plateau: the spread of the last five means is under a limit."""
    m = _rounds(spark, d).groupBy("round").agg(F.avg("v").alias("m"))
    w = Window.orderBy("round").rowsBetween(-4, 0)
    return m.select("round", F.round(F.max("m").over(w) - F.min("m").over(w), 4).alias("spread"), F.count("*").over(w).alias("seen")).withColumn("plateau", (F.col("seen") == 5) & (F.col("spread") < 40))


def spearman_rounds(spark, d):
    """Rank correlation of each round with the one before, average ranks for ties."""
    r = _rounds(spark, d)
    j = r.join(r.select((F.col("round") + 1).alias("round"), "user_id", F.col("v").alias("u")), ["round", "user_id"])
    rank = lambda c: F.rank().over(Window.partitionBy("round").orderBy(c)) + (F.count("*").over(Window.partitionBy("round", c)) - 1) / 2.0
    return j.select("round", rank("v").alias("a"), rank("u").alias("b")).groupBy("round").agg(F.round(F.corr("a", "b"), 6).alias("rho"))


def quantile_summary(spark, d):
    return long_scores(spark, d).groupBy("arm", "head").agg(F.round(F.percentile("score", 0.99), 6).alias("p99"), F.round(F.avg("score"), 6).alias("mean"), F.min("score").alias("low"), F.max("score").alias("high"), F.count_if(F.col("score") > 0.1).alias("over"))


_P = "p AS (SELECT vec_id, 1.0::DOUBLE + vec_id % 3 AS weight, arm, head, round(embedding[1 + 3 * (CASE arm WHEN 'a' THEN 0 ELSE 1 END) + head]::DOUBLE, 2) AS score, label = head AS positive FROM embeddings, (VALUES ('a'), ('b')) AS t(arm), (VALUES (0), (1), (2)) AS h(head))"
_G = "g AS (SELECT arm, head, score, sum(CASE WHEN positive THEN weight ELSE 0 END) AS gp, sum(weight) AS ga FROM p GROUP BY 1, 2, 3), s AS (SELECT *, sum(gp) OVER w AS tp, sum(ga) OVER w AS cum, sum(gp) OVER (PARTITION BY arm, head) AS pos, sum(ga - gp) OVER (PARTITION BY arm, head) AS neg FROM g WINDOW w AS (PARTITION BY arm, head ORDER BY score DESC))"
_Q = f"q AS (SELECT *, row_number() OVER (PARTITION BY arm, head ORDER BY score DESC, vec_id) <= round_even(count(*) OVER (PARTITION BY arm, head) * {RATE}::DOUBLE, 0) AS flag FROM p)"
_R = "r AS (SELECT day(ts) AS round, user_id, round(sum(value), 4) AS v FROM events WHERE day(ts) <= 8 GROUP BY 1, 2)"
_CONF = "sum(CASE WHEN positive AND {0} THEN weight ELSE 0 END) AS tp, sum(CASE WHEN NOT positive AND {0} THEN weight ELSE 0 END) AS fp, sum(CASE WHEN positive AND NOT {0} THEN weight ELSE 0 END) AS fn, sum(CASE WHEN NOT positive AND NOT {0} THEN weight ELSE 0 END) AS tn"
QUERIES = {f.__name__: f for f in (weighted_confusion, fbeta_threshold, f2_low_tie, crossfit_f2, average_precision, roc_auc_midrank, top_decile_lift, cut_at_n, auc_without_ties, quota_topk, hybrid_fusion, uncertainty_max, categorical_argmax, decision_nulls, round_churn, round_gate, spearman_rounds, quantile_summary)}
ORACLE = {
    "weighted_confusion": f"WITH {_P}, c AS (SELECT arm, head, {_CONF.format('score > 0')} FROM p GROUP BY 1, 2) SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(5 * tp / nullif(5 * tp + 4 * fn + fp, 0), 6) AS f2 FROM c",
    "fbeta_threshold": f"WITH {_P}, {_G}, f AS (SELECT *, round(2 * tp / (pos + cum), 15) AS f FROM s) SELECT arm, head, round(score, 6) AS threshold, round(f, 6) AS f FROM (SELECT *, row_number() OVER (PARTITION BY arm, head ORDER BY f DESC, score DESC) AS k FROM f) WHERE k = 1",
    "f2_low_tie": f"WITH {_P}, {_G}, f AS (SELECT *, round(5 * tp / (4 * pos + cum), 15) AS f FROM s) SELECT arm, head, round(score, 6) AS threshold, round(f, 6) AS f FROM (SELECT *, row_number() OVER (PARTITION BY arm, head ORDER BY f DESC, score) AS k FROM f) WHERE k = 1",
    "crossfit_f2": f"""WITH {_P}, a AS (SELECT *, CAST(vec_id % 3 AS INTEGER) AS fold FROM p), o AS (SELECT arm, head, k, score, sum(CASE WHEN positive THEN weight ELSE 0 END) AS gp, sum(weight) AS ga FROM a, (VALUES (0), (1), (2)) AS t(k) WHERE fold <> k GROUP BY 1, 2, 3, 4),
s AS (SELECT *, sum(gp) OVER w AS tp, sum(ga) OVER w AS cum, sum(gp) OVER (PARTITION BY arm, head, k) AS pos FROM o WINDOW w AS (PARTITION BY arm, head, k ORDER BY score DESC)),
t AS (SELECT arm, head, k AS fold, score AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY arm, head, k ORDER BY round(5 * tp / (4 * pos + cum), 15) DESC, score) AS n FROM s) WHERE n = 1)
SELECT a.arm, a.head, a.fold, round(threshold, 6) AS threshold, {_CONF.format('score >= threshold')} FROM a JOIN t ON a.arm = t.arm AND a.head = t.head AND a.fold = t.fold GROUP BY 1, 2, 3, 4""",
    "average_precision": f"WITH {_P}, {_G} SELECT arm, head, round(sum(gp * tp / cum) / nullif(sum(gp), 0), 6) AS ap FROM s GROUP BY 1, 2",
    "roc_auc_midrank": f"WITH {_P}, {_G} SELECT arm, head, round(sum(gp * (neg - (cum - tp) + 0.5::DOUBLE * (ga - gp))) / nullif(max(pos) * max(neg), 0), 6) AS auc FROM s GROUP BY 1, 2",
    "top_decile_lift": f"WITH {_P}, q AS (SELECT *, row_number() OVER (PARTITION BY arm, head ORDER BY score DESC, vec_id) <= greatest(1, count(*) OVER (PARTITION BY arm, head) // 10) AS flag FROM p) SELECT arm, head, count(*) FILTER (WHERE flag) AS n, count(*) FILTER (WHERE flag AND positive) AS hits, round((count(*) FILTER (WHERE flag AND positive)::DOUBLE / count(*) FILTER (WHERE flag)) / nullif(avg(CAST(positive AS DOUBLE)), 0), 6) AS lift FROM q GROUP BY 1, 2",
    "cut_at_n": f"WITH {_P}, k AS (SELECT *, rank() OVER (PARTITION BY arm, head ORDER BY score DESC) AS r FROM p) SELECT arm, head, min(score) AS threshold, count(*) AS kept FROM k WHERE r <= 25 GROUP BY 1, 2",
    "auc_without_ties": f"WITH {_P} SELECT a.arm, a.head, round(avg(CAST(a.score > b.score AS DOUBLE)), 6) AS auc FROM p a JOIN p b ON a.arm = b.arm AND a.head = b.head AND a.positive AND NOT b.positive GROUP BY 1, 2",
    "quota_topk": f"WITH {_P}, {_Q} SELECT vec_id, arm, head FROM q WHERE flag",
    "hybrid_fusion": f"WITH {_P}, {_Q}, h AS (SELECT vec_id, head, bool_or(flag) AS c, bool_and(flag) AS s, max(score) - min(score) AS spread FROM q GROUP BY 1, 2) SELECT vec_id, coalesce(string_agg('h' || CAST(head AS VARCHAR), ',' ORDER BY head) FILTER (WHERE c), '') AS candidates, coalesce(string_agg('h' || CAST(head AS VARCHAR), ',' ORDER BY head) FILTER (WHERE s), '') AS consensus, round(max(spread), 6) AS spread_max FROM h GROUP BY 1",
    "uncertainty_max": f"WITH {_P} SELECT vec_id, round(max(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - abs(score - 0.3::DOUBLE) / CASE WHEN score < 0.3::DOUBLE THEN 0.3::DOUBLE ELSE 1.0::DOUBLE - 0.3::DOUBLE END))), 6) AS uncertainty FROM p GROUP BY 1",
    "categorical_argmax": "WITH v AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: round(x::DOUBLE, 4)) AS a, list_transform(embedding[5:8], lambda x: round(x::DOUBLE, 4)) AS b FROM embeddings), m AS (SELECT *, list_transform([1, 2, 3, 4], lambda i: (a[i] + b[i]) / 2) AS m, list_transform([1, 2, 3, 4], lambda i: abs(a[i] - b[i])) AS df FROM v) SELECT vec_id, CAST(list_position(m, list_max(m)) AS INTEGER) AS winner, list_position(a, list_max(a)) = list_position(b, list_max(b)) AS agree, round(list_max(df), 4) AS max_diff FROM m",
    "decision_nulls": "WITH e AS (SELECT CASE WHEN vec_id % 5 <> 0 THEN round(embedding[1]::DOUBLE, 2) > 0 END AS a, CASE WHEN vec_id % 7 <> 0 THEN round(embedding[2]::DOUBLE, 2) > 0 END AS b FROM embeddings) SELECT CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a OR b END AS candidate, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a AND b END AS consensus, count(*) AS n FROM e GROUP BY 1, 2",
    "round_churn": f"WITH {_R}, j AS (SELECT coalesce(a.round, b.round + 1) AS round, a.user_id AS x, b.user_id AS y FROM r a FULL JOIN r b ON a.round = b.round + 1 AND a.user_id = b.user_id) SELECT CAST(round AS INTEGER) AS round, count(*) FILTER (WHERE x IS NULL OR y IS NULL) AS changed, count(*) AS either, round(count(*) FILTER (WHERE x IS NULL OR y IS NULL)::DOUBLE / greatest(count(*), 1), 6) AS churn FROM j WHERE round BETWEEN 2 AND 8 GROUP BY 1",
    "round_gate": f"WITH {_R}, m AS (SELECT round, avg(v) AS m FROM r GROUP BY 1), w AS (SELECT CAST(round AS INTEGER) AS round, round(max(m) OVER o - min(m) OVER o, 4) AS spread, count(*) OVER o AS seen FROM m WINDOW o AS (ORDER BY round ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT *, seen = 5 AND spread < 40 AS plateau FROM w",
    "spearman_rounds": f"WITH {_R}, j AS (SELECT a.round, a.v, b.v AS u FROM r a JOIN r b ON a.round = b.round + 1 AND a.user_id = b.user_id), k AS (SELECT round, rank() OVER (PARTITION BY round ORDER BY v) + (count(*) OVER (PARTITION BY round, v) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY round ORDER BY u) + (count(*) OVER (PARTITION BY round, u) - 1) / 2.0::DOUBLE AS b FROM j) SELECT CAST(round AS INTEGER) AS round, round(corr(a, b), 6) AS rho FROM k GROUP BY 1",
    "quantile_summary": f"WITH {_P} SELECT arm, head, round(quantile_cont(score, 0.99), 6) AS p99, round(avg(score), 6) AS mean, min(score) AS low, max(score) AS high, count(*) FILTER (WHERE score > 0.1::DOUBLE) AS over FROM p GROUP BY 1, 2",
}
