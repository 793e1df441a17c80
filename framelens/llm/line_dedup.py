"""Exact line deduplication by levelled sorted runs of line hashes.

A run is a table of (h, owner) in buckets by h, each sorted by h: h is the 128-bit hash of a line's key, owner
the smallest doc_id that holds the line. Documents come in batches of ascending doc_id. Each batch's distinct
keys are bucketed in the same way and meet all runs by merge joins, bucket by bucket, without a shuffle; those that
no run has are added as a run of their own at level 0. When a level has `fanout` runs they are merged, again
bucket by bucket, into one sorted run of the next level. The runs stay under a path with a manifest, so a
later job can reopen them and give them further batches; a line that a run has then stays with its owner.

Owners come back to the lines of all batches by one join on batch and h. A key of more than 1/HOT of a batch's lines is joined by a
broadcast, as there are fewer than HOT of these, so that no task gets all lines of a common key.

A line's key is the line without `[\\x20\\x09-\\x0D]` at both ends, A-Z in lower case. Keys of 10 code
points or more that at least two documents hold lose all their lines but those of the smallest doc_id.

Defined cases: a null or empty text is one empty line; a null doc_id counts as smaller than any other;
rows that repeat a doc_id are one document for ownership, and each row keeps its own lines; an empty
table gives an empty result; other columns of the input, whatever their names, are passed on untouched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelens.llm.common import NULL_ID, bound, keyed, scratch, unkeyed, written

MIN_KEY, HOT = 10, 1000
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """Only A-Z are folded: lower() does that for pure ASCII, translate() for the rest."""
    core = F.trim(line, F.lit(WHITE))
    return F.when(F.octet_length(core) == F.char_length(core), F.lower(core)).otherwise(F.translate(core, UPPER, LOWER))


def _bucketed(df: DataFrame, path: str, n: int) -> DataFrame:
    """df (h, ...) written in n buckets by h, sorted by h. Only the files stay: the catalog's entry goes at once."""
    spark = df.sparkSession
    if n != int(spark.conf.get("spark.sql.shuffle.partitions")):
        df = df.repartition(n, "h")
    name = f"line_run_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(n, "h").sortBy("h").option("compression", "zstd").option("path", path).saveAsTable(name)
    return _opened(spark, name)


def _opened(spark: SparkSession, name: str) -> DataFrame:
    df = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return df


class LineRuns:
    """The runs by level, under a folder that all executors reach. Runs that a merge has replaced stay readable for
    plans that use them. The number of buckets is that of the session's shuffle partitions when the folder is new,
    and stays what it was."""

    MANIFEST = "version long, level int, run string, buckets int"

    def __init__(self, spark: SparkSession, fanout: int = 4, path: str | None = None):
        self.spark, self.fanout, self.path = spark, fanout, path or scratch(spark, "line-runs")
        self.buckets, self.version, self.levels = int(spark.conf.get("spark.sql.shuffle.partitions")), 0, [[]]

    @classmethod
    def reopen(cls, spark: SparkSession, path: str, fanout: int = 4) -> LineRuns:
        """The runs that the newest version of the manifest names."""
        self = cls(spark, fanout, path)
        said = spark.read.schema(cls.MANIFEST).json(f"{path}/manifest")
        newest = said.where(F.col("version") == said.agg(F.max("version")).first()[0]).orderBy("level", "run").collect()
        self.version, self.buckets = newest[0]["version"], newest[0]["buckets"]
        self.levels = [[] for _ in range(newest[-1]["level"] + 1)]
        for r in newest:
            name, at = f"line_run_{uuid.uuid4().hex}", f"{path}/{r['run']}"
            spark.sql(f"CREATE TABLE {name} (h BINARY, owner BIGINT) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{at}'")
            self.levels[r["level"]].append((r["run"], _opened(spark, name)))
        return self

    def runs(self) -> list[DataFrame]:
        return [df for level in self.levels for _, df in level]

    def _write(self, df: DataFrame, level: int) -> None:
        run = f"run-{self.version:06d}-l{level}-{uuid.uuid4().hex[:8]}"
        self.levels[level].append((run, _bucketed(df, f"{self.path}/{run}", self.buckets)))

    def _commit(self) -> None:
        self.version += 1
        rows = [F.struct(F.lit(self.version).cast("long").alias("version"), F.lit(k).alias("level"), F.lit(run).alias("run"), F.lit(self.buckets).alias("buckets")) for k, level in enumerate(self.levels) for run, _ in level]
        self.spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows))).write.mode("append").json(f"{self.path}/manifest")

    def meet(self, firsts: DataFrame) -> DataFrame:
        """firsts (h, ...), one row a key, with `known`, the owner in the run that has the key, or null: written in the
        buckets of the runs, so that it meets them without a shuffle. At most one run has a key."""
        out = firsts.withColumn("known", F.lit(None).cast("long"))
        for run in self.runs():
            out = out.join(run.withColumnRenamed("owner", "_other").hint("merge"), "h", "left").withColumn("known", F.coalesce("known", "_other")).drop("_other")
        return _bucketed(out, scratch(self.spark, "line-firsts"), self.buckets)

    def add(self, met: DataFrame) -> None:
        """met: what meet() has given for rows (h, owner, ...). Keys that no run has are a run of their own."""
        self._write(met.where("known IS NULL").select("h", "owner"), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged = self.levels[level][0][1]
            for _, run in self.levels[level][1:]:
                # no two runs share a key
                merged = merged.join(run.withColumnRenamed("owner", "_other").hint("merge"), "h", "full").select("h", F.coalesce("owner", "_other").alias("owner"))
            if level + 1 == len(self.levels):
                self.levels.append([])
            self._write(merged, level + 1)
            self.levels[level] = []
            level += 1
        self._commit()


def _bounds(docs: DataFrame, n: int) -> list[int]:
    """At most n - 1 ids that cut the documents into batches of about equal counts."""
    at = [i / n for i in range(1, n)]
    got = docs.agg(F.percentile_approx("_id", at, 1000).alias("q")).first()["q"] if at else None
    return sorted(set(got or []))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 4, fanout: int = 4, kept_col: str = "kept_text", runs: LineRuns | None = None) -> DataFrame:
    """All columns of docs, then n_lines, n_dropped (long) and the text without the dropped lines; they replace columns of these names.
    runs: those of earlier documents, whose lines go from these too; they get the keys of docs."""
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped", *([kept_col] if kept_col != text_col else []))
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    base = docs.select(
        keyed(id_col).alias("_id"), F.col(text_col).alias("_text"),
        *([F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)]).alias("_rest")] if rest else []),
    )
    ids = base.select("_id")
    cuts = _bounds(ids, batches)
    batch = F.lit(0)
    for i, c in enumerate(cuts):
        batch = F.when(F.col("_id") > F.lit(c), i + 1).otherwise(batch)
    text = F.coalesce("_text", F.lit(""))
    lines = base.select("_id", F.xxhash64(text).alias("_tx"), F.posexplode(F.split(text, "\n", -1)).alias("_pos", "_line"))
    keys = lines.select(batch.alias("_batch"), "_id", "_tx", "_pos", line_key(F.col("_line")).alias("_key"))
    keys = keys.where(F.char_length("_key") >= MIN_KEY).select("_batch", "_id", "_tx", "_pos", F.unhex(F.md5("_key")).alias("h"))
    keys = written(keys, "line-keys", ["_batch"])

    # runs of this call alone need not have the keys of the last batch
    stay, runs, found = runs is not None, runs or LineRuns(spark, fanout), None
    for i in range(len(cuts) + 1):
        own = keys.where(F.col("_batch") == i)
        seen = runs.meet(own.groupBy("h").agg(F.min("_id").alias("owner"), F.max("_id").alias("last"), F.count("*").alias("n")))
        if stay or i < len(cuts):
            runs.add(seen)
        often = F.col("n") * HOT > (seen.agg(F.sum("n")).first()[0] or 0)
        owner = F.coalesce("known", "owner")
        one = seen.where((F.col("owner") != owner) | (F.col("last") != owner)).select(F.lit(i).alias("_batch"), "h", owner.alias("owner"), often.alias("_often"))
        found = one if found is None else found.union(one)
    found = written(found, "line-owners")
    hot = F.broadcast(found.where("_often").drop("_often"))
    other = keys.join(hot.drop("owner"), ["_batch", "h"], "left_anti").join(found.where("NOT _often").drop("_often"), ["_batch", "h"])
    lost = keys.join(hot, ["_batch", "h"]).unionByName(other)
    drops = lost.where(F.col("_id") != F.col("owner")).select("_id", "_tx", "_pos")
    drops = drops.groupBy("_id", "_tx").agg(F.collect_set("_pos").alias("_drop"))

    out = base.withColumn("_tx", F.xxhash64(text)).join(drops, ["_id", "_tx"], "left")
    keep = bound("split(coalesce(_text, ''), '\\n', -1)", "array_join(transform(array_except(sequence(0, size(l) - 1), _drop), i -> l[i]), '\\n')", "l")
    n_lines = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    names = [unkeyed("_id").alias(id_col) if c == id_col else F.col("_text").alias(c) if c == text_col else F.col(f"_rest.c{rest.index(c)}").alias(c) for c in docs.columns]
    return out.select(
        *names,
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("_drop").isNull(), text).otherwise(F.expr(keep)).alias(kept_col),
    )


__all__ = ["LineRuns", "dedup_lines", "line_key", "MIN_KEY", "NULL_ID"]
