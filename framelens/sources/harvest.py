"""Archived pages of a harvest, put in order by their resumption tokens, with what is missing, loops or comes twice.

The first page of a chain was asked for without a token; each page names the token of the next, the last one none. Places are found by pointer
doubling: after k rounds each page points 2^k pages on, so a chain of n pages takes log2 n joins, not n."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelens.sources.workspace import scratch, written

#: What is read of a page.
PAGE = "ListRecords struct<record: array<struct<header: struct<identifier: string, datestamp: string>>>, resumptionToken: string>"


def parsed(pages: DataFrame, xml: Column) -> DataFrame:
    """pages with `next` (null at the end) and `records` (identifier, datestamp) of each page's XML; a page that isn't XML has neither."""
    x = pages.withColumn("_x", F.from_xml(xml, PAGE))
    token = F.trim(F.col("_x.ListRecords.resumptionToken"))
    records = F.transform("_x.ListRecords.record", lambda r: F.struct(r["header"]["identifier"].alias("identifier"), r["header"]["datestamp"].alias("datestamp")))
    return x.withColumns({"next": F.nullif(token, F.lit("")), "records": F.coalesce(records, F.array().cast("array<struct<identifier:string,datestamp:string>>"))}).drop("_x")


def placed(pages: DataFrame, spark: SparkSession) -> DataFrame:
    """chain, token, next and place (0 for the first page, null for a page that no token leads to). pages: chain, token (null for the first), next, and
    retrieved; of several pages of one request the last retrieved stays."""
    key = lambda c: F.coalesce(F.concat(F.lit("t"), F.col(c)), F.lit("first"))
    last = pages.groupBy("chain", key("token").alias("node")).agg(F.max_by(F.struct("token", "next"), F.struct("retrieved", F.coalesce("next", F.lit("")))).alias("p"))
    nodes = last.select("chain", "node", "p.token", "p.next", F.when(F.col("p.next").isNotNull(), F.concat(F.lit("t"), F.col("p.next"))).alias("to"), F.when(F.col("node") == "first", 0).cast("long").alias("place"))
    now = written(nodes, scratch(spark, "harvest"))
    longest = now.groupBy("chain").count().agg(F.max("count")).first()[0] or 0
    step = 1
    while step < longest:
        # those that are reached reach what they point to; then all point twice as far
        ahead = now.where("place IS NOT NULL AND to IS NOT NULL").groupBy("chain", F.col("to").alias("node")).agg((F.min("place") + step).alias("_place"))
        far = now.select("chain", F.col("node").alias("to"), F.col("to").alias("_to"))
        now = now.join(ahead, ["chain", "node"], "left").join(far, ["chain", "to"], "left").select("chain", "node", "token", "next", F.col("_to").alias("to"), F.least("place", "_place").alias("place"))
        now = written(now, scratch(spark, "harvest"))
        step *= 2
    return now.select("chain", "token", "next", "place")


def report(pages: DataFrame, places: DataFrame) -> DataFrame:
    """For each chain: its pages, those in the chain and those not, gap (the token that the last page in it names, if there is no such page), loop (the token that leads
    back), records in the chain, and how many of them came before."""
    own = places.where("place IS NOT NULL")
    ahead = places.select("chain", F.col("token").alias("next"), F.col("place").alias("_ahead"), F.lit(True).alias("_there"))
    links = own.join(ahead, ["chain", "next"], "left")
    ends = links.groupBy("chain").agg(
        F.max(F.when(F.col("next").isNotNull() & F.col("_there").isNull(), F.col("next"))).alias("gap"), F.max(F.when(F.col("_ahead") <= F.col("place"), F.col("next"))).alias("loop")
    )
    counts = places.groupBy("chain").agg(F.count("*").alias("pages"), F.count("place").alias("in_chain"))
    r = records(pages, places).groupBy("chain").agg(F.count("*").alias("records"), F.count_if(F.col("seen") > 1).alias("repeated"))
    out = counts.join(ends, "chain", "left").join(r, "chain", "left")
    return out.select("chain", "pages", "in_chain", (F.col("pages") - F.col("in_chain")).alias("apart"), "gap", "loop", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("repeated", F.lit(0)).alias("repeated"))


def records(pages: DataFrame, places: DataFrame) -> DataFrame:
    """chain, place, position, identifier, datestamp, and seen: 1 for an identifier's first record in the chain, 2 for its second, and so on."""
    from pyspark.sql.window import Window

    last = pages.groupBy("chain", F.coalesce(F.concat(F.lit("t"), F.col("token")), F.lit("first")).alias("node")).agg(F.max_by("records", F.struct("retrieved", F.coalesce("next", F.lit("")))).alias("records"))
    own = places.where("place IS NOT NULL").select("chain", F.coalesce(F.concat(F.lit("t"), F.col("token")), F.lit("first")).alias("node"), "place")
    rows = last.join(own, ["chain", "node"]).select("chain", "place", F.posexplode("records").alias("position", "r")).select("chain", "place", "position", "r.*")
    return rows.withColumn("seen", F.row_number().over(Window.partitionBy("chain", "identifier").orderBy("place", "position")))


def latest(rows: DataFrame) -> DataFrame:
    """Of the records of an identifier the one with the latest datestamp, of equal ones the last in the chain."""
    return rows.groupBy("chain", "identifier").agg(F.max_by(F.struct("place", "position", "datestamp"), F.struct("datestamp", "place", "position")).alias("r")).select("chain", "identifier", "r.*")
