"""Versions on disk, look-up files, harvested pages and balanced folds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from framelens.operators import sampling, search
from framelens.session import table
from framelens.sources import harvest, versions
from framelens.sources.workspace import scratch


def versioned_tables(spark, d):
    """Events published by type as versions: one replaced, one refused for its count, one by a writer that came too late; what is active after each step and what is read in the end."""
    root = scratch(spark, "versions")
    e = table(spark, d, "events").select("event_type", "event_id", F.round("value", 4).alias("value"))
    of = lambda kind: e.where(F.col("event_type") == kind).drop("event_type")
    n = {r["event_type"]: r["n"] for r in e.groupBy("event_type").agg(F.count("*").alias("n")).collect()}
    versions.publish(of("click"), root, "click", n["click"])
    late = versions.stage(of("purchase"), root, "purchase", n["purchase"])
    versions.publish(of("view"), root, "view", n["view"])
    steps = [("late", versions.activate(spark, root, late, 1))]
    try:
        versions.publish(of("purchase"), root, "purchase", n["purchase"] + 1)
    except versions.LoadRefused:
        steps.append(("short", False))
    even = of("click").where("event_id % 2 = 0")
    versions.publish(even, root, "click", even.count())
    rows = [(h["sequence"], h["version"], h["rows"], None) for h in versions.history(spark, root)] + [(0, name, 0, ok) for name, ok in steps]
    told = spark.createDataFrame(rows, "sequence int, version string, rows long, won boolean")
    now = versions.read(spark, root).groupBy("version").agg(F.count("*").alias("read"), F.round(F.sum("value"), 2).alias("total"))
    last = told.agg(F.max("sequence").alias("sequence"))
    return told.join(now.crossJoin(last), ["version", "sequence"], "left")


PATTERNS = ["%red%", "%ue%ot%", "S%all%", "%o_d%", "%zz_none%", "%a%"]


def trigram_search(spark, d):
    """Parts whose name is like a pattern in any case, by the trigram table."""
    p, path = table(spark, d, "part").select("p_partkey", "p_name"), scratch(spark, "trigrams")
    search.write_postings(p, "p_partkey", "p_name", path, files=8)
    found = [search.search(p, "p_partkey", "p_name", path, x).select(F.lit(x).alias("pattern"), "p_partkey") for x in PATTERNS]
    return reduce(lambda a, b: a.unionByName(b), found)


def facet_prefix(spark, d):
    """The most frequent values that begin with what was typed, from the facet's sorted files."""
    path = scratch(spark, "facets")
    search.write_facets(table(spark, d, "part").select(F.split("p_type", " ")[0].alias("kind")).unionByName(table(spark, d, "part").select(F.col("p_brand").alias("kind"))), "kind", path, files=4)
    found = [search.facets_like(spark, path, x, 5).select(F.lit(x).alias("typed"), "value", "n") for x in ("brand#1", "s", "LAR", "none")]
    return reduce(lambda a, b: a.unionByName(b), found)


# -- harvested pages: a chain for each status of an order, a page for every 100 keys

def _archive(spark, d):
    """XML of pages by the token they were asked for. Each repeats the first record of the page before it; in chain F the page of number 5 is missing, the last page of chain P
    leads back to page 1, and a page of chain O was archived twice."""
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("chain"), F.col("o_orderkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("at"))
    pages = o.withColumn("page", F.floor(F.col("k") / 400)).groupBy("chain", "page").agg(F.array_sort(F.collect_list(F.struct("k", "at"))).alias("rs"))
    from pyspark.sql.window import Window

    w = Window.partitionBy("chain").orderBy("page")
    pages = pages.select("chain", (F.row_number().over(w) - 1).alias("i"), F.count("*").over(Window.partitionBy("chain")).alias("n"), F.concat(F.coalesce(F.slice(F.lag("rs").over(w), 1, 1), F.slice("rs", 1, 0)), "rs").alias("rs"))
    token = lambda i: F.concat("chain", F.lit("-"), i.cast("string"))
    ahead = F.when(F.col("i") + 1 < F.col("n"), token(F.col("i") + 1)).when(F.col("chain") == "P", token(F.lit(1)))
    one = lambda r: F.concat(F.lit("<record><header><identifier>oai:"), r["k"].cast("string"), F.lit("</identifier><datestamp>"), r["at"], F.lit("</datestamp></header></record>"))
    xml = F.concat(F.lit("<OAI-PMH><ListRecords>"), F.array_join(F.transform("rs", one), ""), F.coalesce(F.concat(F.lit("<resumptionToken>"), ahead, F.lit("</resumptionToken>")), F.lit("<resumptionToken/>")), F.lit("</ListRecords></OAI-PMH>"))
    own = pages.select("chain", F.when(F.col("i") > 0, token(F.col("i"))).alias("token"), F.lit(1).alias("retrieved"), xml.alias("xml"), "i").where("NOT (chain = 'F' AND i = 5)")
    return own.unionByName(own.where("chain = 'O' AND i = 2").withColumn("retrieved", F.lit(0)).withColumn("xml", F.lit("cut <"))).drop("i")


def oai_harvest(spark, d):
    """What the archive of each chain holds: pages in it and apart, gap, loop, records and repeated ones."""
    pages = harvest.parsed(_archive(spark, d), F.col("xml")).drop("xml")
    return harvest.report(pages, harvest.placed(pages, spark))


def oai_records(spark, d):
    """Records of the chains by month, each identifier once."""
    pages = harvest.parsed(_archive(spark, d), F.col("xml")).drop("xml")
    r = harvest.latest(harvest.records(pages, harvest.placed(pages, spark)))
    return r.groupBy("chain", F.substring("datestamp", 1, 7).alias("month")).agg(F.count("*").alias("records"))


def balanced_folds(spark, d):
    """Folds of whole sources from the largest on; a sixteenth of the documents has no source and is dealt one by one."""
    docs = table(spark, d, "documents").select("doc_id", F.when(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) != "f", F.col("source")).alias("source"))
    out = sampling.balanced_folds(docs, "source", "doc_id", 5)
    split = out.where("source IS NOT NULL").groupBy("source").agg(F.count_distinct("fold").alias("folds")).agg(F.max("folds").alias("most"))
    return out.groupBy("fold").agg(F.count("*").alias("docs")).join(split).select("fold", "docs", F.col("most").alias("folds_of_a_source"))


QUERIES = {f.__name__: f for f in (versioned_tables, trigram_search, facet_prefix, oai_harvest, oai_records, balanced_folds)}
_PAGES = """o AS (SELECT o_orderstatus AS chain, o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey // 400 AS page FROM orders),
p AS (SELECT chain, page, count(*) AS own, min(k) AS first FROM o GROUP BY 1, 2),
i AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY chain) AS n, lag(first) OVER w AS extra FROM p WINDOW w AS (PARTITION BY chain ORDER BY page)),
h AS (SELECT *, chain = 'F' AND i = 5 AS gone FROM i),
c AS (SELECT *, NOT gone AND (chain <> 'F' OR i < 5) AS inside FROM h)"""
ORACLE = {
    "versioned_tables": """WITH e AS (SELECT event_type, event_id, round(value, 4) AS value FROM events), n AS (SELECT event_type, count(*) AS n FROM e GROUP BY 1),
s AS (SELECT 1 AS sequence, 'click' AS version, (SELECT n FROM n WHERE event_type = 'click') AS rows, NULL::BOOLEAN AS won UNION ALL SELECT 2, 'view', (SELECT n FROM n WHERE event_type = 'view'), NULL
      UNION ALL SELECT 3, 'click', (SELECT count(*) FROM e WHERE event_type = 'click' AND event_id % 2 = 0), NULL UNION ALL SELECT 0, 'late', 0, FALSE UNION ALL SELECT 0, 'short', 0, FALSE)
SELECT version, sequence, rows, won, CASE WHEN sequence = 3 THEN rows END AS read, CASE WHEN sequence = 3 THEN (SELECT round(sum(value), 2) FROM e WHERE event_type = 'click' AND event_id % 2 = 0) END AS total FROM s""",
    "trigram_search": " UNION ALL ".join(f"SELECT '{x}' AS pattern, p_partkey FROM part WHERE p_name ILIKE '{x}'" for x in PATTERNS),
    "facet_prefix": "WITH k AS (SELECT kind AS value, count(*) AS n FROM (SELECT split_part(p_type, ' ', 1) AS kind FROM part UNION ALL SELECT p_brand FROM part) WHERE kind <> '' GROUP BY 1) "
    + " UNION ALL ".join(f"SELECT * FROM (SELECT '{x}' AS typed, value, n FROM k WHERE starts_with(lower(value), lower('{x}')) ORDER BY n DESC, value LIMIT 5)" for x in ("brand#1", "s", "LAR", "none")),
    "oai_harvest": f"""WITH {_PAGES} SELECT chain, count(*) FILTER (WHERE NOT gone) AS pages, count(*) FILTER (WHERE inside) AS in_chain, count(*) FILTER (WHERE NOT gone AND NOT inside) AS apart,
CASE WHEN chain = 'F' AND max(n) > 5 THEN 'F-5' END AS gap, CASE WHEN chain = 'P' AND max(n) > 1 THEN 'P-1' END AS loop,
CAST(sum(own + CASE WHEN extra IS NULL THEN 0 ELSE 1 END) FILTER (WHERE inside) AS BIGINT) AS records, count(extra) FILTER (WHERE inside) AS repeated FROM c GROUP BY chain""",
    "oai_records": f"WITH {_PAGES} SELECT o.chain, substr(day, 1, 7) AS month, count(*) AS records FROM o JOIN c ON o.chain = c.chain AND o.page = c.page WHERE inside GROUP BY 1, 2",
    "balanced_folds": """WITH RECURSIVE s AS (SELECT coalesce(CASE WHEN substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) <> 'f' THEN source END, 'i' || doc_id) AS g FROM documents), z AS (SELECT row_number() OVER (ORDER BY count(*) DESC, g) AS i, count(*) AS n FROM s GROUP BY g),
r AS (SELECT CAST(0 AS BIGINT) AS i, [CAST(0 AS BIGINT), 0, 0, 0, 0] AS load UNION ALL
      SELECT z.i, list_transform(range(1, 6), lambda f: load[f] + CASE WHEN f = list_position(load, list_min(load)) THEN z.n ELSE 0 END) FROM r JOIN z ON z.i = r.i + 1)
SELECT CAST(f - 1 AS INTEGER) AS fold, load[f] AS docs, CAST(1 AS BIGINT) AS folds_of_a_source FROM (SELECT load, unnest(range(1, 6)) AS f FROM r ORDER BY i DESC LIMIT 5) WHERE load[f] > 0""",
}
