"""Joins, set operations and fallbacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from framelens.session import table


def retraction_gap(spark, d):
    """Two sources of one flag disagree: the one-to-many join is resolved by a row per key."""
    li = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_returnflag") == "R").alias("r")).groupBy("l_orderkey").agg(F.max("r").alias("returned"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderstatus") == "F").alias("closed"))
    return li.join(o, "l_orderkey").groupBy("returned", "closed").agg(F.count("*").alias("works"))


def severity_pick(spark, d):
    """One row an order by severity of its return flag, then line number."""
    rank = F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_returnflag") == "A", 2).otherwise(1)
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", rank.alias("severity"))
    best = li.groupBy("l_orderkey").agg(F.max(F.struct("severity", F.negate("l_linenumber").alias("n"), "l_returnflag")).alias("b"))
    return best.select("l_orderkey", (-F.col("b.n")).alias("l_linenumber"), F.col("b.l_returnflag").alias("nature"))


def dedup_first(spark, d):
    """First event of each user and type by time and id."""
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    return e.groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


def dedup_last_wins(spark, d):
    """The last round wins for each user and type."""
    e = table(spark, d, "events").select("user_id", "event_type", F.dayofmonth("ts").alias("round"), "event_id", F.round("value", 4).alias("value"))
    return e.groupBy("user_id", "event_type").agg(F.max_by(F.struct("round", "value"), F.struct("round", "event_id")).alias("b")).select("user_id", "event_type", "b.round", "b.value")


def _arms(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type")
    return [e.where(F.col("event_type") == t).groupBy("user_id").agg(F.count("*").alias(f"n_{i}")) for i, t in enumerate(("click", "view", "purchase"))]


def full_outer_arms(spark, d):
    return reduce(lambda a, b: a.join(b, "user_id", "outer"), _arms(spark, d)).select("user_id", "n_0", "n_1", "n_2")


def arm_set_equality(spark, d):
    """Ids missing on either side of two arms."""
    a, b, _ = _arms(spark, d)
    j = a.join(b, "user_id", "outer")
    return j.agg(F.count_if(F.col("n_0").isNull()).alias("missing_first"), F.count_if(F.col("n_1").isNull()).alias("missing_second"), F.count_if(F.col("n_0").isNotNull() & F.col("n_1").isNotNull()).alias("in_both"))


def orphan_labels(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").where("n_chars > 500").select("doc_id"), "doc_id", "left_anti").select("doc_id")


def exists_labels(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")


def left_gap(spark, d):
    """Share of documents with no label by language, groups of 12 or more."""
    j = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    g = j.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality").isNull()).alias("missing"))
    return g.where("n >= 12").select("lang", "n", "missing", F.round(100.0 * F.col("missing") / F.col("n"), 1).alias("pct"))


def three_way_using(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    lab = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    vec = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("vec_label"))
    return docs.join(lab, "doc_id").join(vec, "doc_id")


def semi_pinned(spark, d):
    """Orders with a line from a pinned supplier."""
    pin = table(spark, d, "supplier").where("s_nationkey = 3").select(F.col("s_suppkey").alias("l_suppkey"))
    hit = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(pin, "l_suppkey", "left_semi").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(hit, "o_orderkey", "left_semi")


def anti_prior(spark, d):
    prior = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"))
    return table(spark, d, "documents").select("doc_id").join(prior, "doc_id", "left_anti")


def in_subquery_case(spark, d):
    """prior_labeled, title_ineligible or covered."""
    prior = table(spark, d, "labels").select("doc_id").distinct().withColumn("prior", F.lit(True))
    s = F.when(F.col("prior"), "prior_labeled").when(F.coalesce(F.char_length("text"), F.lit(0)) <= 200, "title_ineligible").otherwise("covered")
    return table(spark, d, "documents").select("doc_id", "text").join(prior, "doc_id", "left").groupBy(s.alias("segment")).agg(F.count("*").alias("n"))


def fallback_cascade(spark, d):
    """First source that has a value, with its name."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    a = table(spark, d, "labels").where("quality = 1").select("doc_id", F.col("toxic").alias("a"))
    b = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("b"))
    j = docs.join(a, "doc_id", "left").join(b, "doc_id", "left")
    src = F.when(F.col("a").isNotNull(), "labels").when(F.col("b").isNotNull(), "embeddings").otherwise("none")
    return j.groupBy(src.alias("origin"), F.coalesce("a", "b").alias("value")).agg(F.count("*").alias("n"))


def existence_overlap(spark, d):
    """Lists against a pinned list: any in common, unknown only for an unknown list."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("s"))
    return li.where(F.arrays_overlap("s", F.array(*[F.lit(x).cast("long") for x in (1, 5, 9)]))).select("l_orderkey")


def _sets(spark, d):
    o = table(spark, d, "orders")
    return o.where("o_orderstatus = 'F'").select("o_custkey").distinct(), o.where("o_totalprice > 200000").select("o_custkey").distinct()


def set_union(spark, d):
    a, b = _sets(spark, d)
    return a.union(b).distinct()


def set_intersect(spark, d):
    a, b = _sets(spark, d)
    return a.intersect(b)


def set_except(spark, d):
    a, b = _sets(spark, d)
    return a.subtract(b)


def set_measures(spark, d):
    """Sizes, symmetric difference, Jaccard (1 for two empty sets), capture-recapture."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.max(F.col("o_orderstatus") == "F").alias("a"), F.max(F.col("o_totalprice") > 200000).alias("b"))
    n = lambda c: F.count_if(c)
    a, b = F.col("a"), F.col("b")
    m = o.agg(n(a).alias("r1"), n(b).alias("r2"), n(a & b).alias("n_both"), n(a | b).alias("either"), n(a != b).alias("symdiff"))
    return m.select("*", (F.col("r1") + F.col("r2") - F.col("n_both")).alias("incl_excl"), F.round(F.when(F.col("either") == 0, 1.0).otherwise(F.try_divide("n_both", "either")), 6).alias("jaccard"), F.round(F.try_divide(F.col("r1") * F.col("r2"), "n_both"), 4).alias("lincoln"))


def union_shards(spark, d):
    """Shards by nation are put together; an id in two shards would show."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    u = reduce(lambda x, y: x.unionByName(y), [c.where(F.col("c_nationkey") % 4 == k) for k in range(4)])
    return u.agg(F.count("*").alias("rows"), F.count_distinct("c_custkey").alias("ids"))


def manifest_diff(spark, d):
    """Partitions that are listed but not done."""
    e = table(spark, d, "events").select(F.to_date("ts").alias("part"))
    return e.distinct().join(e.where(F.dayofmonth("part") <= 20).distinct(), "part", "left_anti").select(F.col("part").cast("string").alias("part"))


def group_having(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 6).alias("mean")).where("n > 12")


def first_in_list(spark, d):
    """First list member among given ones; empty lists are unknown."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.when(F.col("l_quantity") > 25, F.col("l_suppkey")))).alias("s"))
    return li.where(F.try_element_at("s", F.lit(1)).isin(1, 2, 3)).select("l_orderkey")


def null_safe_equal(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("a"), F.nullif(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")), F.lit("O")).alias("b"))
    return o.agg(F.count_if(F.col("a") == F.col("b")).alias("plain"), F.count_if(F.col("a").eqNullSafe(F.col("b"))).alias("null_safe"), F.count("*").alias("n"))


_C = "a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 200000)"
_A = "arms AS (SELECT user_id, nullif(count(*) FILTER (WHERE event_type = 'click'), 0) AS n_0, nullif(count(*) FILTER (WHERE event_type = 'view'), 0) AS n_1, nullif(count(*) FILTER (WHERE event_type = 'purchase'), 0) AS n_2 FROM events GROUP BY 1)"
QUERIES = {f.__name__: f for f in (retraction_gap, severity_pick, dedup_first, dedup_last_wins, full_outer_arms, arm_set_equality, orphan_labels, exists_labels, left_gap, three_way_using, semi_pinned, anti_prior, in_subquery_case, fallback_cascade, existence_overlap, set_union, set_intersect, set_except, set_measures, union_shards, manifest_diff, group_having, first_in_list, null_safe_equal)}
ORACLE = {
    "retraction_gap": "SELECT returned, o_orderstatus = 'F' AS closed, count(*) AS works FROM (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1) JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2",
    "severity_pick": "SELECT l_orderkey, l_linenumber, l_returnflag AS nature FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END DESC, l_linenumber, l_returnflag DESC) AS k FROM lineitem) WHERE k = 1",
    "dedup_first": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1",
    "dedup_last_wins": "SELECT user_id, event_type, round, value FROM (SELECT user_id, event_type, CAST(day(ts) AS INTEGER) AS round, round(value, 4) AS value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY day(ts) DESC, event_id DESC) AS k FROM events) WHERE k = 1",
    "full_outer_arms": f"WITH {_A} SELECT * FROM arms WHERE n_0 IS NOT NULL OR n_1 IS NOT NULL OR n_2 IS NOT NULL",
    "arm_set_equality": f"WITH {_A} SELECT count(*) FILTER (WHERE n_0 IS NULL) AS missing_first, count(*) FILTER (WHERE n_1 IS NULL) AS missing_second, count(*) FILTER (WHERE n_0 IS NOT NULL AND n_1 IS NOT NULL) AS in_both FROM arms WHERE n_0 IS NOT NULL OR n_1 IS NOT NULL",
    "orphan_labels": "SELECT doc_id FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND n_chars > 500)",
    "exists_labels": "SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)",
    "left_gap": "SELECT lang, count(*) AS n, count(*) FILTER (WHERE quality IS NULL) AS missing, round(100.0::DOUBLE * count(*) FILTER (WHERE quality IS NULL) / count(*), 1) AS pct FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1 HAVING count(*) >= 12",
    "three_way_using": "SELECT doc_id, lang, quality, toxic, e.label AS vec_label FROM documents JOIN labels USING (doc_id) JOIN embeddings e ON e.vec_id = doc_id",
    "semi_pinned": "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3))",
    "anti_prior": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark)",
    "in_subquery_case": "SELECT CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'prior_labeled' WHEN coalesce(length(text), 0) <= 200 THEN 'title_ineligible' ELSE 'covered' END AS segment, count(*) AS n FROM documents GROUP BY 1",
    "fallback_cascade": "SELECT CASE WHEN a.toxic IS NOT NULL THEN 'labels' WHEN e.label IS NOT NULL THEN 'embeddings' ELSE 'none' END AS origin, coalesce(a.toxic, e.label) AS value, count(*) AS n FROM documents d LEFT JOIN (SELECT * FROM labels WHERE quality = 1) a USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY 1, 2",
    "existence_overlap": "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_suppkey IN (1, 5, 9)",
    "set_union": f"WITH {_C} SELECT * FROM a UNION SELECT * FROM b",
    "set_intersect": f"WITH {_C} SELECT * FROM a INTERSECT SELECT * FROM b",
    "set_except": f"WITH {_C} SELECT * FROM a EXCEPT SELECT * FROM b",
    "set_measures": """WITH o AS (SELECT o_custkey, bool_or(o_orderstatus = 'F') AS a, bool_or(o_totalprice > 200000) AS b FROM orders GROUP BY 1),
m AS (SELECT count(*) FILTER (WHERE a) AS r1, count(*) FILTER (WHERE b) AS r2, count(*) FILTER (WHERE a AND b) AS n_both, count(*) FILTER (WHERE a OR b) AS either, count(*) FILTER (WHERE a <> b) AS symdiff FROM o)
SELECT *, r1 + r2 - n_both AS incl_excl, round(CASE WHEN either = 0 THEN 1.0 ELSE n_both::DOUBLE / either END, 6) AS jaccard, round((r1 * r2)::DOUBLE / nullif(n_both, 0), 4) AS lincoln FROM m""",
    "union_shards": "SELECT count(*) AS rows, count(DISTINCT c_custkey) AS ids FROM customer",
    "manifest_diff": "SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) AS part FROM events WHERE day(ts) > 20",
    "group_having": "SELECT o_custkey, count(*) AS n, round(avg(o_totalprice), 6) AS mean FROM orders GROUP BY 1 HAVING count(*) > 12",
    "first_in_list": "SELECT l_orderkey FROM lineitem WHERE l_quantity > 25 GROUP BY 1 HAVING min(l_suppkey) IN (1, 2, 3)",
    "null_safe_equal": "SELECT count(*) FILTER (WHERE a = b) AS plain, count(*) FILTER (WHERE a IS NOT DISTINCT FROM b) AS null_safe, count(*) AS n FROM (SELECT nullif(o_orderstatus, 'P') AS a, nullif(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END, 'O') AS b FROM orders)",
}
