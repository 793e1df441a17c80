"""Networks, memberships and list columns: orders stand for works, lineitem suppliers for their institutions, parts for their authors."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelens.functions.text import surrogate
from framelens.operators import network
from framelens.session import table

CAP, TOP = 5, 160


def _members(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey")


def collab_edges(spark, d):
    return network.edges(_members(spark, d), "l_orderkey", "l_suppkey", CAP, TOP)


def collab_nodes(spark, d):
    e = network.edges(_members(spark, d), "l_orderkey", "l_suppkey", CAP)
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.trim("s_name").alias("name"))
    return network.nodes(e).join(s, "id").select("id", "name", "degree", "strength")


def collab_summary(spark, d):
    m = _members(spark, d).select("l_orderkey", "l_suppkey").distinct()
    t = m.groupBy("l_orderkey").agg(F.count("*").alias("team"))
    return t.agg(
        F.count("*").alias("works"), F.count_if(F.col("team") > CAP).alias("over_cap"), F.count_if(F.col("team") == 1).alias("single"),
        F.sum("team").alias("memberships"), F.max("team").alias("largest"), F.sum(F.when(F.col("team").between(2, CAP), F.col("team") * (F.col("team") - 1) / 2).otherwise(0)).cast("long").alias("pairs"),
    )


def affil_top4(spark, d):
    return network.top_affiliations(_members(spark, d), "l_partkey", "l_suppkey", "l_orderkey", 4)


def latest_name(spark, d):
    """Latest spelling of a name: nulls are skipped and ties fall to the larger name."""
    o = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("name"))
    return o.where("name is not null").groupBy("o_custkey").agg(F.max_by("name", F.struct("y", "name")).alias("name"), F.max("y").cast("int").alias("year"))


def authorship_extract(spark, d):
    """(work, author, place) rows from a nested list of authors with their places, nulls and repeats dropped."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    inner = li.groupBy("l_orderkey", "l_partkey").agg(F.collect_list(F.when(F.col("l_suppkey") % 3 != 0, F.col("l_suppkey"))).alias("places"))
    nested = inner.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_partkey", "places")).alias("authors"))
    a = nested.select("l_orderkey", F.explode("authors").alias("a")).select("l_orderkey", "a.l_partkey", F.explode(F.filter("a.places", lambda x: x.isNotNull() & (x % 2 == 0))).alias("place"))
    return a.distinct().select(F.col("l_orderkey").alias("work_id"), F.col("l_partkey").alias("author_id"), F.concat(F.lit("I"), F.col("place").cast("string")).alias("place_id"))


def _delimited(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("s")).distinct()
    return li.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("s")), "; ").alias("ca_places"))


def delimited_lists(spark, d):
    return _delimited(spark, d)


def delimited_explode(spark, d):
    return _delimited(spark, d).select(F.explode(F.split("ca_places", "; ")).alias("place")).groupBy("place").agg(F.count("*").alias("works"))


def delimited_member(spark, d):
    return _delimited(spark, d).where(F.array_contains(F.split("ca_places", "; "), "S7")).select("l_orderkey")


def surrogate_keys(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", surrogate("I", F.col("s_name")).alias("key"))


def list_distinct_flat(spark, d):
    """Distinct members of nested lists, nulls dropped before and after."""
    o = table(spark, d, "orders").select("o_custkey", F.array(F.nullif("o_orderstatus", F.lit("P")), F.substring("o_orderpriority", 1, 1)).alias("l"))
    g = o.groupBy("o_custkey").agg(F.collect_list("l").alias("ll"))
    return g.select("o_custkey", F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.flatten("ll")))), ",").alias("members"))


_M = "m AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), t AS (SELECT l_orderkey, count(*) AS team FROM m GROUP BY 1)"
_E = f"""WITH {_M}, e AS (SELECT a.l_suppkey AS source, b.l_suppkey AS target, CAST(count(*) AS INTEGER) AS works
FROM m a JOIN m b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey JOIN t ON t.l_orderkey = a.l_orderkey WHERE t.team <= {CAP} GROUP BY 1, 2)"""
_D = "WITH x AS (SELECT l_orderkey, string_agg(s, '; ' ORDER BY s) AS ca_places FROM (SELECT DISTINCT l_orderkey, 'S' || CAST(l_suppkey AS VARCHAR) AS s FROM lineitem) GROUP BY 1)"
QUERIES = {f.__name__: f for f in (collab_edges, collab_nodes, collab_summary, affil_top4, latest_name, authorship_extract, delimited_lists, delimited_explode, delimited_member, surrogate_keys, list_distinct_flat)}
ORACLE = {
    "collab_edges": f"{_E} SELECT * FROM e ORDER BY works DESC, source, target LIMIT {TOP}",
    "collab_nodes": f"""{_E}, n AS (SELECT source AS id, works FROM e UNION ALL SELECT target, works FROM e)
SELECT id, trim(s_name) AS name, CAST(count(*) AS INTEGER) AS degree, CAST(sum(works) AS BIGINT) AS strength FROM n JOIN supplier ON s_suppkey = id GROUP BY 1, 2""",
    "collab_summary": f"""WITH {_M} SELECT count(*) AS works, count(*) FILTER (WHERE team > {CAP}) AS over_cap, count(*) FILTER (WHERE team = 1) AS single, CAST(sum(team) AS BIGINT) AS memberships, max(team) AS largest,
CAST(sum(CASE WHEN team BETWEEN 2 AND {CAP} THEN team * (team - 1) / 2 ELSE 0 END) AS BIGINT) AS pairs FROM t""",
    "affil_top4": "SELECT * FROM (SELECT l_partkey, l_suppkey, count(DISTINCT l_orderkey) AS works, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY count(DISTINCT l_orderkey) DESC, l_suppkey) AS INTEGER) AS rank FROM lineitem GROUP BY 1, 2) WHERE rank <= 4",
    "latest_name": "SELECT o_custkey, last(name ORDER BY y, name) AS name, CAST(max(y) AS INTEGER) AS year FROM (SELECT o_custkey, year(o_orderdate) AS y, nullif(o_orderpriority, '5-LOW') AS name FROM orders) WHERE name IS NOT NULL GROUP BY 1",
    "authorship_extract": "SELECT DISTINCT l_orderkey AS work_id, l_partkey AS author_id, 'I' || CAST(l_suppkey AS VARCHAR) AS place_id FROM lineitem WHERE l_suppkey % 3 <> 0 AND l_suppkey % 2 = 0",
    "delimited_lists": f"{_D} SELECT * FROM x",
    "delimited_explode": f"{_D} SELECT place, count(*) AS works FROM (SELECT unnest(string_split(ca_places, '; ')) AS place FROM x) GROUP BY 1",
    "delimited_member": f"{_D} SELECT l_orderkey FROM x WHERE list_contains(string_split(ca_places, '; '), 'S7')",
    "surrogate_keys": "SELECT s_suppkey, 'I' || substr(md5(trim(s_name)), 1, 16) AS key FROM supplier",
    "list_distinct_flat": "SELECT o_custkey, string_agg(DISTINCT v, ',' ORDER BY v) AS members FROM (SELECT o_custkey, unnest([nullif(o_orderstatus, 'P'), substr(o_orderpriority, 1, 1)]) AS v FROM orders) WHERE v IS NOT NULL GROUP BY 1",
}
