"""Admission routes and strata on orders: nullable Boolean routes, kept three-valued."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelens.functions.nulls import count_true, is_not_true, known_true
from framelens.session import table

#: Route: its predicate on orders, in SQL that both engines read alike. Unknown comes from nullif.
ROUTES = {
    "route_aff": "o_orderstatus = 'F'",
    "route_fund": "o_totalprice > 150000.0",
    "route_venue": "nullif(o_orderpriority, '5-LOW') = '1-URGENT'",
    "route_about": "nullif(o_orderstatus, 'P') = 'O' AND o_custkey % 7 = 0",
}


def flags(spark, d):
    """Each route computed once, before anything filters on it."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate")
    return o.select("o_orderkey", "o_orderdate", *[F.expr(p).alias(r) for r, p in ROUTES.items()])


def _any():
    out = F.lit(False)
    for r in ROUTES:
        out = out | F.col(r)
    return out


def route_flags(spark, d):
    f = flags(spark, d).where(F.year("o_orderdate").between(1993, 1997) & _any())
    return f.select("o_orderkey", *ROUTES)


def route_venn(spark, d):
    f = flags(spark, d).select("o_orderkey", F.explode(F.array(*[F.struct(F.lit(r).alias("route"), F.col(r).alias("on"), F.greatest(*[known_true(F.col(x)).cast("int") for x in ROUTES if x != r]).alias("others")) for r in ROUTES])).alias("x"))
    return f.groupBy("x.route").agg(count_true(F.col("x.on")).alias("works"), count_true(F.col("x.on") & (F.col("x.others") == 0)).alias("only_here"), F.count_if(F.col("x.on").isNull()).alias("unknown"))


def null_invisible(spark, d):
    """Rows that a predicate and its negation both drop."""
    return flags(spark, d).agg(count_true(F.col("route_venue")).alias("covered"), count_true(~F.col("route_venue")).alias("refused"), F.count_if(F.col("route_venue").isNull()).alias("invisible"), F.count("*").alias("n"))


def strata(spark, d):
    """Exclusive strata by precedence; what no route is true for, unknown or not, is the residual."""
    s = F.coalesce(*[F.when(known_true(F.col(r)), F.lit(r)) for r in ROUTES], F.lit("residual"))
    return flags(spark, d).withColumn("stratum", s)


def strata_counts(spark, d):
    return strata(spark, d).groupBy("stratum").agg(F.count("*").alias("n"))


def strata_residual(spark, d):
    f = flags(spark, d)
    p = F.lit(True)
    for r in ROUTES:
        p = p & is_not_true(F.col(r))
    return f.where(p).select("o_orderkey")


def strata_overlap(spark, d):
    """All pairs of routes from one aggregate."""
    names = list(ROUTES)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    row = flags(spark, d).agg(*[count_true(F.col(a) & F.col(b)).alias(f"{a}|{b}") for a, b in pairs])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"`{a}|{b}`").alias("n")) for a, b in pairs])).alias("x")).select("x.*")


def partition_check(spark, d):
    """Invariant: the strata sum to the frame, none is empty."""
    s = strata(spark, d)
    parts = [*ROUTES, "residual"]
    return s.agg(F.count("*").alias("frame"), F.count_if(F.col("stratum").isin(parts)).alias("covered"), F.count_distinct("stratum").alias("strata"), F.count_if(F.col("stratum").isNull()).alias("unassigned"))


def nulls_to_false(spark, d):
    f = flags(spark, d)
    return f.select("o_orderkey", *[known_true(F.col(r)).alias(r) for r in ROUTES])


def invariant_routes(spark, d):
    """Rule: a published row has a true route. Rows that were let in without one are planted."""
    published = flags(spark, d).where(F.coalesce(_any(), F.lit(False)) | (F.col("o_orderkey") % 97 == 0))
    p = F.lit(False)
    for r in ROUTES:
        p = p | known_true(F.col(r))
    return published.agg(F.count("*").alias("checked"), F.count_if(~p).alias("violations"), F.min(F.when(~p, F.col("o_orderkey"))).alias("first"))


def zero_probability(spark, d):
    s = flags(spark, d)
    p = F.col("route_venue") | F.col("route_about")
    return s.agg(count_true(p).alias("covered"), count_true(~p).alias("orphan"), F.count_if(p.isNull()).alias("invisible"))


def priority_strata(spark, d):
    """First stratum that a document matches, in one pass; prior items and short texts are left out."""
    t = F.lower("text")
    s = F.coalesce(F.when(t.contains("ation"), "a_term"), F.when(F.col("lang") == "fr", "b_french"), F.when(F.col("n_chars") > 4000, "c_long"), F.lit("d_rest"))
    docs = table(spark, d, "documents").where(F.col("text").isNotNull() & (F.char_length("text") > 10))
    prior = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"))
    return docs.select("doc_id", s.alias("stratum")).join(prior, "doc_id", "left_anti")


_F = "f AS (SELECT o_orderkey, o_orderdate, " + ", ".join(f"({p}) AS {r}" for r, p in ROUTES.items()) + " FROM orders)"
_ANY = " OR ".join(ROUTES)
_CASE = "CASE " + " ".join(f"WHEN coalesce({r}, FALSE) THEN '{r}'" for r in ROUTES) + " ELSE 'residual' END"
_names = list(ROUTES)
QUERIES = {f.__name__: f for f in (route_flags, route_venn, null_invisible, strata_counts, strata_residual, strata_overlap, partition_check, nulls_to_false, invariant_routes, zero_probability, priority_strata)}
ORACLE = {
    "route_flags": f"WITH {_F} SELECT o_orderkey, {', '.join(ROUTES)} FROM f WHERE year(o_orderdate) BETWEEN 1993 AND 1997 AND ({_ANY})",
    "route_venn": f"WITH {_F} " + " UNION ALL ".join(f"SELECT '{r}' AS route, count(*) FILTER (WHERE {r}) AS works, count(*) FILTER (WHERE {r} AND NOT ({' OR '.join(f'coalesce({x}, FALSE)' for x in ROUTES if x != r)})) AS only_here, count(*) FILTER (WHERE {r} IS NULL) AS unknown FROM f" for r in ROUTES),
    "null_invisible": f"WITH {_F} SELECT count(*) FILTER (WHERE route_venue) AS covered, count(*) FILTER (WHERE NOT route_venue) AS refused, count(*) FILTER (WHERE route_venue IS NULL) AS invisible, count(*) AS n FROM f",
    "strata_counts": f"WITH {_F} SELECT {_CASE} AS stratum, count(*) AS n FROM f GROUP BY 1",
    "strata_residual": f"WITH {_F} SELECT o_orderkey FROM f WHERE {' AND '.join(f'({r}) IS NOT TRUE' for r in ROUTES)}",
    "strata_overlap": f"WITH {_F} " + " UNION ALL ".join(f"SELECT '{a}' AS first, '{b}' AS second, count(*) FILTER (WHERE {a} AND {b}) AS n FROM f" for i, a in enumerate(_names) for b in _names[i + 1 :]),
    "partition_check": f"WITH {_F}, s AS (SELECT {_CASE} AS stratum FROM f) SELECT count(*) AS frame, count(stratum) AS covered, count(DISTINCT stratum) AS strata, count(*) - count(stratum) AS unassigned FROM s",
    "nulls_to_false": f"WITH {_F} SELECT o_orderkey, {', '.join(f'coalesce({r}, FALSE) AS {r}' for r in ROUTES)} FROM f",
    "invariant_routes": f"WITH {_F}, g AS (SELECT o_orderkey, {' OR '.join(f'coalesce({r}, FALSE)' for r in ROUTES)} AS ok FROM f) SELECT count(*) AS checked, count(*) FILTER (WHERE NOT ok) AS violations, min(o_orderkey) FILTER (WHERE NOT ok) AS first FROM g WHERE ok OR o_orderkey % 97 = 0",
    "zero_probability": f"WITH {_F} SELECT count(*) FILTER (WHERE route_venue OR route_about) AS covered, count(*) FILTER (WHERE NOT (route_venue OR route_about)) AS orphan, count(*) FILTER (WHERE (route_venue OR route_about) IS NULL) AS invisible FROM f",
    "priority_strata": "SELECT doc_id, CASE WHEN contains(lower(text), 'ation') THEN 'a_term' WHEN lang = 'fr' THEN 'b_french' WHEN n_chars > 4000 THEN 'c_long' ELSE 'd_rest' END AS stratum FROM documents WHERE text IS NOT NULL AND length(text) > 10 AND doc_id NOT IN (SELECT item_id FROM benchmark)",
}
