"""Collaboration networks: pairs of members that share works."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def capped(members: DataFrame, work: str, member: str, cap: int) -> DataFrame:
    """Distinct memberships of works with 2 to cap members. The cap comes before any pairing: pairs grow with
    the square of a team, so what is left is at most cap - 1 rows for each membership."""
    m = members.select(work, member).distinct()
    small = m.groupBy(work).agg(F.count("*").alias("team")).where(F.col("team").between(2, cap)).select(work)
    return m.join(small, work, "left_semi")


def edges(members: DataFrame, work: str, member: str, cap: int, top: int | None = None) -> DataFrame:
    m = capped(members, work, member, cap)
    a, b = m.select(work, F.col(member).alias("source")), m.select(work, F.col(member).alias("target"))
    out = a.join(b, work).where("source < target").groupBy("source", "target").agg(F.count("*").cast("int").alias("works"))
    return out.orderBy(F.desc("works"), "source", "target").limit(top) if top else out


def nodes(edge: DataFrame) -> DataFrame:
    ends = edge.select(F.col("source").alias("id"), "works").unionByName(edge.select(F.col("target").alias("id"), "works"))
    return ends.groupBy("id").agg(F.count("*").cast("int").alias("degree"), F.sum("works").alias("strength"))


def top_affiliations(members: DataFrame, person: str, place: str, work: str, k: int) -> DataFrame:
    """The k places with most distinct works of each person."""
    n = members.groupBy(person, place).agg(F.count_distinct(work).alias("works"))
    w = Window.partitionBy(person).orderBy(F.desc("works"), F.asc(place))
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
