"""Contracts as violation queries: each gives the rows that break a rule, none if it holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.join(parent.select(key), key, "left_anti")


def outside(df: DataFrame, column: str, allowed: list) -> DataFrame:
    return df.where(F.col(column).isNull() | ~F.col(column).isin(allowed))


def more_than_one(df: DataFrame, active: Column, by: list[str]) -> DataFrame:
    return df.where(active).groupBy(*by).agg(F.count("*").alias("active")).where("active > 1")


def codes(rules: dict[str, Column]) -> Column:
    """Codes of the rules that a row breaks, in order; an unknown outcome breaks a rule."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(c)) for c, ok in rules.items()]))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of both, the largest version of each key; new wins equal versions."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    kept = [c for c in old.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*kept), F.struct(version, "_new")).alias("r")).select(*keys, "r.*")


def replace_versions(old: DataFrame, new: DataFrame, version: str) -> DataFrame:
    """Rows of old whose version new doesn't have, and all rows of new."""
    return old.join(new.select(version).distinct(), version, "left_anti").select(*old.columns).unionByName(new)


def activated(registry: DataFrame, rows: DataFrame, version: str, chosen) -> DataFrame:
    """registry with `chosen` active and all others not. Refused where its rows aren't as many as row_count says."""
    said = [r["row_count"] for r in registry.where(F.col(version) == chosen).select("row_count").collect()]
    have = rows.where(F.col(version) == chosen).count()
    if said != [have]:
        raise ValueError(f"version {chosen!r} has {have} rows, its registry says {said}")
    return registry.withColumn("active", F.col(version) == chosen)


def among(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose value is in a list given as a parameter; null is in no list."""
    some = sorted({v for v in values if v is not None})
    given = df.sparkSession.createDataFrame([(v,) for v in some], df.select(column).schema)
    return df.join(given, column, "left_semi").select(*df.columns)


def inventory(df: DataFrame, part: str, id_col: str) -> DataFrame:
    """Rows, bounds and ordered digest of each part: SHA-256 over the ids in order, each after its length as 4 big-endian
    bytes. A part is of bounded size, as its ids are brought together."""
    own = F.col(id_col).cast("string")
    framed = F.concat(F.lpad(F.hex(F.octet_length(own).cast("long")), 8, "0"), F.hex(own.cast("binary")))
    g = df.groupBy(part).agg(F.count("*").alias("rows"), F.min(id_col).alias("first"), F.max(id_col).alias("last"), F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("i"), framed.alias("f")))).alias("ids"))
    return g.select(part, "rows", "first", "last", F.sha2(F.unhex(F.array_join(F.transform("ids", lambda x: x["f"]), "")), 256).alias("digest"))


def differing(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids that only one side has, each with the side that lacks it."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    return x.join(y, key, "outer").where("_a IS NULL OR _b IS NULL").select(key, F.when(F.col("_a").isNull(), "first").otherwise("second").alias("missing_in"))


def missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each value that must be there and isn't: the row and the name of its column."""
    return df.select("*", F.explode(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]))).alias("column"))


def served(df: DataFrame, fields: list[str]) -> DataFrame:
    """For each field that is wanted: whether df has a column for it, its rows, and how many leave it null or empty."""
    have = [f for f in fields if f in df.columns]
    g = df.agg(F.count("*").alias("_rows"), *[F.count_if(F.coalesce(F.col(f).cast("string"), F.lit("")) == "").alias(f) for f in have])
    rows = [F.struct(F.lit(f).alias("field"), F.lit(f in have).alias("has_column"), F.col("_rows").alias("rows"), F.col(f if f in have else "_rows").alias("empty")) for f in fields]
    return g.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
