"""The whole decision record, exact and tail probabilities, the judge, the dossier, intervals, the gate of a loop and published filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelens.functions import text as T
from framelens.operators import contracts as C
from framelens.operators import stats
from framelens.plans import agreement, records
from framelens.session import table

# -- the decision record with the scores of both arms


AXES = records.AXES | {"genre": (["commentary", "protocol", "dataset"], 23)}


def decision_record(spark, d):
    """All 35 columns of the record: that of prediction_row with a third axis and the packed scores of both arms that it follows from."""
    return records.record(spark, d, AXES, True)


# -- tests


def _strata(a, marked, drawn):
    one = lambda c: F.count_if(c).cast("long")
    g = a.groupBy(F.coalesce("lang", F.lit("und")).alias("lang")).agg(F.count("*").alias("n"), one(marked).alias("marked"), one(drawn).alias("drawn"), one(marked & drawn).alias("both"))
    return g.agg(F.sum("n").alias("n"), F.sum("marked").alias("marked"), F.sum("drawn").alias("drawn"), F.sum("both").alias("both"), F.collect_list(F.struct("n", "marked", "drawn", "both")).alias("strata"))


def permutation_p(spark, d):
    """Exact share of the within-language shuffles of one arm whose agreement with the other reaches the observed one: rows that agree are n - marked - drawn + 2 x both, so only
    counts are needed."""
    s = _strata(agreement.arms(spark, d).where("b_quality IS NOT NULL"), F.col("b_quality") == 1, F.col("a_quality") == 1)
    return s.select((F.col("n") - F.col("marked") - F.col("drawn") + 2 * F.col("both")).alias("observed"), F.round(stats.permutation_reached(F.col("strata")), 6).alias("p"))


def agent_permutation(spark, d):
    """Whether two agents differ, conditioned on language: exact share of the within-language shuffles whose 2 x 2 statistic reaches the observed one."""
    s = _strata(agreement.arms(spark, d).withColumn("agent", F.col("doc_id") % 2), F.col("a_toxic") == 1, F.col("agent") == 1)
    return s.select("n", "marked", "drawn", "both", F.round(stats.permutation_as_far(F.col("strata")), 6).alias("p"))


def chisq_p(spark, d):
    """Statistic with and without correction, and the chance of a larger one."""
    g = agreement.chisq_stat(spark, d)
    return g.select("plain", "yates", F.round(stats.chi_square_tail(F.col("plain")), 6).alias("p_plain"), F.round(stats.chi_square_tail(F.col("yates")), 6).alias("p_yates"))


def _verdicts(spark, d):
    """Contested rows of three arms (quality by a, by b, and not toxic), with what a judge said (0, 1, or 2, with which no arm agrees)."""
    said = F.when(F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("j"))), 1, 1) < "3", 2).otherwise(F.col("a_quality"))
    a = agreement.arms(spark, d).where("b_quality IS NOT NULL").select("doc_id", "lang", "w", F.col("a_quality").alias("x"), F.col("b_quality").alias("y"), (1 - F.col("a_toxic")).alias("z"), said.alias("judge"))
    return a.withColumn("n_in", F.col("x") + F.col("y") + F.col("z"))


def judge_agreement(spark, d):
    """How often a judge of contested rows agrees with each arm and with none, and whether the three counts differ by more than chance (two degrees of freedom)."""
    g = _verdicts(spark, d).where("n_in BETWEEN 1 AND 2").agg(
        F.count("*").alias("contested"), *[F.count_if(F.col("judge") == F.col(c)).alias(f"with_{c}") for c in "xyz"], F.count_if((F.col("judge") != F.col("x")) & (F.col("judge") != F.col("y")) & (F.col("judge") != F.col("z"))).alias("with_none")
    )
    counts = [F.col(f"with_{c}").cast("double") for c in "xyz"]
    mean = (counts[0] + counts[1] + counts[2]) / 3.0
    stat = F.try_divide(reduce(lambda s, c: s + (c - mean) * (c - mean), counts, F.lit(0.0)), mean)
    return g.select("*", F.round(F.try_divide(F.greatest(*counts), F.least(*counts)), 2).alias("spread"), F.round(stat, 6).alias("statistic"), F.round(F.exp(-stat / 2), 6).alias("p"))


def dossier(spark, d):
    """Each row that any arm took in, with what every arm said and its genre, and whether it is contested."""
    v = _verdicts(spark, d).where("n_in > 0")
    arm = lambda c: F.struct(F.col(c).alias("said"), records._genre(f"g{c}").alias("genre"))
    return v.select("doc_id", "lang", "w", "n_in", F.col("n_in").isin(1, 2).alias("contested"), F.to_json(F.struct(*[arm(c).alias(c) for c in "xyz"])).alias("arms"))


def extrapolated(spark, d):
    """The base rate of labelled documents times all documents, with the exact interval's ends."""
    g = table(spark, d, "labels").agg(F.count_if(F.col("toxic") == 1).alias("k"), F.count("toxic").alias("n"))
    frame = table(spark, d, "documents").agg(F.count("*").alias("frame"))
    g = g.join(frame).withColumn("ci", stats.clopper_pearson("k", "n"))
    at = lambda c: F.round(c * F.col("frame"), 3)
    return g.select("k", "n", "frame", at(F.col("k") / F.col("n")).alias("expected"), at(F.col("ci.low")).alias("low"), at(F.col("ci.high")).alias("high"))


# -- the gate of a loop


GAIN, CHURN, RHO = 0.02, 0.45, -0.2


def loop_gate(spark, d):
    """For each day of events as a round: the gain of the last five means over the one before them, the largest churn and the least rank correlation of the last three rounds,
    and whether all three pass."""
    e = table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.round(F.sum("value"), 4).alias("v"))
    days = e.select("day").distinct().select("day", F.row_number().over(Window.orderBy("day")).alias("round"))  # a row a day
    r = e.join(F.broadcast(days), "day").select("round", "user_id", "v")
    back = r.select((F.col("round") + 1).alias("round"), "user_id", F.col("v").alias("u"))
    both = r.join(back, ["round", "user_id"], "outer").join(F.broadcast(days.select("round").where("round > 1")), "round")
    rank = lambda c: F.rank().over(Window.partitionBy("round").orderBy(c)) + (F.count("*").over(Window.partitionBy("round", c)) - 1) / 2.0
    rho = both.where("u IS NOT NULL AND v IS NOT NULL").select("round", rank("v").alias("a"), rank("u").alias("b")).groupBy("round").agg(F.corr("a", "b").alias("rho"))
    churn = both.groupBy("round").agg((F.count_if(F.col("u").isNull() | F.col("v").isNull()) / F.greatest(F.count("*"), F.lit(1))).alias("churn"))
    m = r.groupBy("round").agg(F.avg("v").alias("m")).join(churn, "round", "left").join(rho, "round", "left")
    w = Window.orderBy("round")  # a row a round
    three, five = w.rowsBetween(-2, 0), w.rowsBetween(-4, 0)
    base = F.lag("m", 5).over(w)
    m = m.select(
        "round", F.round(F.when(base > 0, (F.max("m").over(five) - base) / base), 6).alias("gain"), F.round(F.when(F.count("churn").over(three) == 3, F.max("churn").over(three)), 6).alias("churn"),
        F.round(F.when(F.count("rho").over(three) == 3, F.min("rho").over(three)), 6).alias("rho"),
    )
    return m.withColumn("passed", F.coalesce((F.col("gain") < GAIN) & (F.col("churn") < CHURN) & (F.col("rho") > RHO), F.lit(False)))


# -- published forms


def prefixed_arms(spark, d):
    """Every column but the key renamed by its arm, and the arms joined so that a row of any stays."""
    a = agreement.arms(spark, d)
    parts = {"x": a.select("doc_id", F.col("a_quality").alias("said"), records._genre("gx").alias("genre")).where("doc_id % 3 <> 0"), "y": a.select("doc_id", F.col("b_quality").alias("said"), records._genre("gy").alias("genre")).where("doc_id % 5 <> 0")}
    return reduce(lambda l, r: l.join(r, "doc_id", "full_outer"), [T.prefixed(df, ["doc_id"], name) for name, df in parts.items()])


def filter_permalinks(spark, d):
    """Filters of orders as canonical JSON (names in order, strings escaped, no null members) and the first 16 digits of its SHA-256."""
    o = table(spark, d, "orders").select("o_orderpriority", "o_orderstatus", F.year("o_orderdate").alias("year")).distinct()
    quoted = F.concat(F.col("o_orderpriority"), F.lit(' "\\'), F.lit("\n\té"))
    c = T.canonical_json({"year": F.col("year"), "priority": quoted, "status": F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")), "both": F.array("o_orderstatus", F.lit("x"))})
    return o.select("o_orderpriority", "o_orderstatus", "year", F.substring(F.sha2(c, 256), 1, 16).alias("hash"))


def not_null_violations(spark, d):
    """Rows of a table that lack what must be there, by column."""
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("user_id")).alias("user_id"), F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("event_type"), "value")
    return C.missing(e, ["event_id", "user_id", "event_type", "value"]).groupBy("column").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


def served_fields(spark, d):
    """Fields that training wants of each document against what its record serves: fields without a column and fields that rows leave empty."""
    rows = table(spark, d, "documents").withColumn("venue", F.when(F.col("doc_id") % 4 != 0, F.col("source")))
    return C.served(rows, ["text", "lang", "venue", "abstract"])


QUERIES = {f.__name__: f for f in (decision_record, permutation_p, agent_permutation, chisq_p, judge_agreement, dossier, extrapolated, loop_gate, prefixed_arms, filter_permalinks, not_null_violations, served_fields)}

_A = agreement._A


def _exact(rows: str, marked: str, drawn: str, test: str) -> str:
    """The hypergeometric numbers of up to five strata, summed stratum by stratum."""
    lf = lambda x: f"lgamma(CAST({x} AS DOUBLE) + 1)"
    chance = f"exp({lf('marked')} - {lf('x')} - {lf('marked - x')} + {lf('n - marked')} - {lf('drawn - x')} - {lf('n - marked - drawn + x')} - {lf('n')} + {lf('drawn')} + {lf('n - drawn')})"
    ctes = f"""{_A}, r AS ({rows}), s AS (SELECT row_number() OVER (ORDER BY lang) AS i, count(*) AS n, count(*) FILTER (WHERE {marked}) AS marked, count(*) FILTER (WHERE {drawn}) AS drawn, count(*) FILTER (WHERE ({marked}) AND ({drawn})) AS b
FROM (SELECT *, coalesce(lang, 'und') AS lang_ FROM r) GROUP BY lang),
u AS (SELECT i, n, marked, drawn, unnest(range(greatest(0, drawn + marked - n), least(marked, drawn) + 1)) AS x FROM s), q AS (SELECT i, x, {chance} AS p FROM u), t0 AS (SELECT CAST(0 AS BIGINT) AS x, 1.0::DOUBLE AS p)"""
    for k in range(1, 6):
        ctes += f", t{k} AS (SELECT t.x + coalesce(q.x, 0) AS x, sum(t.p * coalesce(q.p, 1)) AS p FROM t{k - 1} t LEFT JOIN q ON q.i = {k} GROUP BY 1)"
    return f"WITH {ctes}, o AS (SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(marked) AS BIGINT) AS marked, CAST(sum(drawn) AS BIGINT) AS drawn, CAST(sum(b) AS BIGINT) AS b FROM s) {test}"


_TAIL = lambda x: f"CASE WHEN {x} > 30 THEN 0 WHEN {x} IS NOT NULL THEN round(greatest(0, 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 90), lambda k: power(-1.0::DOUBLE, k) * exp((2 * k + 1) * ln(greatest(sqrt({x} / 2), 1e-300)) - lgamma(k + 1.0::DOUBLE)) / (2 * k + 1)))), 6) END"
_V = f"""{_A}, v AS (SELECT doc_id, lang, w, a_quality AS x, b_quality AS y, 1 - a_toxic AS z, CASE WHEN substr(md5(CAST(doc_id AS VARCHAR) || 'j'), 1, 1) < '3' THEN 2 ELSE a_quality END AS judge, a_quality + b_quality + 1 - a_toxic AS n_in FROM arms WHERE b_quality IS NOT NULL)"""
_GENRE = lambda seed: records._SG.format(seed)
ORACLE = {
    "decision_record": records.record_sql(AXES, True),
    "permutation_p": _exact("SELECT * FROM arms WHERE b_quality IS NOT NULL", "b_quality = 1", "a_quality = 1", "SELECT n - marked - drawn + 2 * b AS observed, (SELECT round(least(1, sum(p)), 6) FROM t5 WHERE x >= o.b) AS p FROM o"),
    "agent_permutation": _exact("SELECT * FROM arms", "a_toxic = 1", "doc_id % 2 = 1", "SELECT n, marked, drawn, b AS both, (SELECT round(least(1, sum(p)), 6) FROM t5 WHERE abs(x * o.n - o.marked * o.drawn) >= abs(o.b * o.n - o.marked * o.drawn)) AS p FROM o").replace("AS both", 'AS "both"'),
    "chisq_p": f"SELECT plain, yates, {_TAIL('plain')} AS p_plain, {_TAIL('yates')} AS p_yates FROM ({agreement.ORACLE['chisq_stat']})",
    "judge_agreement": f"""WITH {_V}, g AS (SELECT count(*) AS contested, count(*) FILTER (WHERE judge = x) AS with_x, count(*) FILTER (WHERE judge = y) AS with_y, count(*) FILTER (WHERE judge = z) AS with_z, count(*) FILTER (WHERE judge NOT IN (x, y, z)) AS with_none FROM v WHERE n_in BETWEEN 1 AND 2),
m AS (SELECT *, (with_x + with_y + with_z) / 3.0::DOUBLE AS m FROM g), c AS (SELECT *, (power(with_x - m, 2) + power(with_y - m, 2) + power(with_z - m, 2)) / nullif(m, 0) AS s FROM m)
SELECT contested, with_x, with_y, with_z, with_none, round(greatest(with_x, with_y, with_z)::DOUBLE / nullif(least(with_x, with_y, with_z), 0), 2) AS spread, round(s, 6) AS statistic, round(exp(-s / 2), 6) AS p FROM c""",
    "dossier": f"""WITH {_V} SELECT doc_id, lang, w, n_in, n_in IN (1, 2) AS contested, '{{' || concat_ws(',', {", ".join(f"'\"{c}\":{{\"said\":' || {c} || ',\"genre\":\"' || {_GENRE('g' + c)} || '\"}}'" for c in "xyz")}) || '}}' AS arms FROM v WHERE n_in > 0""",
    "loop_gate": f"""WITH e AS (SELECT CAST(ts AS DATE) AS day, user_id, round(sum(value), 4) AS v FROM events GROUP BY 1, 2), r AS (SELECT dense_rank() OVER (ORDER BY day) AS round, user_id, v FROM e), n AS (SELECT DISTINCT round FROM r),
b AS (SELECT coalesce(a.round, c.round + 1) AS round, a.v, c.v AS u FROM r a FULL JOIN r c ON a.round = c.round + 1 AND a.user_id = c.user_id), c AS (SELECT round, count(*) FILTER (WHERE u IS NULL OR v IS NULL)::DOUBLE / greatest(count(*), 1) AS churn FROM b WHERE round IN (SELECT round FROM n WHERE round > 1) GROUP BY 1),
k AS (SELECT round, rank() OVER (PARTITION BY round ORDER BY v) + (count(*) OVER (PARTITION BY round, v) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY round ORDER BY u) + (count(*) OVER (PARTITION BY round, u) - 1) / 2.0::DOUBLE AS c FROM b WHERE u IS NOT NULL AND v IS NOT NULL),
s AS (SELECT round, corr(a, c) AS rho FROM k GROUP BY 1), m AS (SELECT round, avg(v) AS m FROM r GROUP BY 1), j AS (SELECT m.round, m, churn, rho, lag(m, 5) OVER (ORDER BY m.round) AS base FROM m LEFT JOIN c ON m.round = c.round LEFT JOIN s ON m.round = s.round),
g AS (SELECT CAST(round AS INTEGER) AS round, round(CASE WHEN base > 0 THEN (max(m) OVER f - base) / base END, 6) AS gain, round(CASE WHEN count(churn) OVER t = 3 THEN max(churn) OVER t END, 6) AS churn, round(CASE WHEN count(rho) OVER t = 3 THEN min(rho) OVER t END, 6) AS rho
FROM j WINDOW f AS (ORDER BY round ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), t AS (ORDER BY round ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT *, coalesce(gain < {GAIN}::DOUBLE AND churn < {CHURN}::DOUBLE AND rho > {RHO}::DOUBLE, FALSE) AS passed FROM g""",
    "prefixed_arms": f"""WITH {_A}, x AS (SELECT doc_id, a_quality AS x_said, {_GENRE('gx')} AS x_genre FROM arms WHERE doc_id % 3 <> 0), y AS (SELECT doc_id, b_quality AS y_said, {_GENRE('gy')} AS y_genre FROM arms WHERE doc_id % 5 <> 0)
SELECT coalesce(x.doc_id, y.doc_id) AS doc_id, x_said, x_genre, y_said, y_genre FROM x FULL JOIN y ON x.doc_id = y.doc_id""",
    "filter_permalinks": """WITH o AS (SELECT DISTINCT o_orderpriority, o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders)
SELECT *, substr(sha256('{"both":["' || o_orderstatus || '","x"],"priority":"' || o_orderpriority || ' \\"\\\\\\n\\té"' || CASE WHEN o_orderstatus <> 'O' THEN ',"status":"' || o_orderstatus || '"' ELSE '' END || ',"year":' || year || '}'), 1, 16) AS hash FROM o""",
    "not_null_violations": "SELECT 'user_id' AS \"column\", count(*) AS n, min(event_id) AS first FROM events WHERE event_id % 7 = 0 OR user_id IS NULL UNION ALL SELECT 'event_type', count(*), min(event_id) FROM events WHERE event_id % 11 = 0 OR event_type IS NULL",
    "served_fields": """SELECT 'text' AS field, TRUE AS has_column, count(*) AS rows, count(*) FILTER (WHERE coalesce(text, '') = '') AS empty FROM documents UNION ALL SELECT 'lang', TRUE, count(*), count(*) FILTER (WHERE coalesce(lang, '') = '') FROM documents
UNION ALL SELECT 'venue', TRUE, count(*), count(*) FILTER (WHERE doc_id % 4 = 0 OR coalesce(source, '') = '') FROM documents UNION ALL SELECT 'abstract', FALSE, count(*), count(*) FROM documents""",
}
