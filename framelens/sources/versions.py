"""Versions of a table on disk: loaded aside, counted, then made active by a pointer that is switched by compare-and-set.

    root/data/version=V/load=L   the rows of one load; a load is written once, by dynamic partition overwrite
    root/pointer/N               N = 1, 2, ...: small JSON files that never change; the one with the largest N is active

A writer says which N it has seen and makes N + 1 by a rename that doesn't overwrite: of two writers that have seen the same N one wins, as far as
the store's rename is atomic (HDFS; not plain object stores). A load that fails, has other rows than announced, or loses leaves what is active
untouched, and readers never see part of a load."""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelens.sources.workspace import filesystem, removed


class LoadRefused(ValueError):
    pass


def _pointers(spark: SparkSession, root: str) -> list[int]:
    fs, p = filesystem(spark, f"{root}/pointer")
    if not fs.exists(p):
        return []
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit())


def _pointer(spark: SparkSession, root: str, n: int) -> dict:
    fs, p = filesystem(spark, f"{root}/pointer/{n}")
    stream = fs.open(p)
    try:
        return {**json.loads(bytes(stream.readAllBytes()).decode()), "sequence": n}
    finally:
        stream.close()


def active(spark: SparkSession, root: str) -> dict | None:
    """sequence, version, load, rows and digest of what is active."""
    known = _pointers(spark, root)
    return _pointer(spark, root, known[-1]) if known else None


def history(spark: SparkSession, root: str) -> list[dict]:
    return [_pointer(spark, root, n) for n in _pointers(spark, root)]


def _folder(root: str, at: dict) -> str:
    return f"{root}/data/version={at['version']}/load={at['load']}"


def read(spark: SparkSession, root: str) -> DataFrame:
    """The active version's rows, with a column `version`."""
    now = active(spark, root)
    if now is None:
        raise LoadRefused(f"{root} has no active version")
    return spark.read.parquet(_folder(root, now)).withColumn("version", F.lit(now["version"]))


def stage(df: DataFrame, root: str, version: str, rows: int, digest: str | None = None) -> dict:
    """Writes a load that isn't active. Refused, and removed, where it hasn't the rows that were announced; refused before it is written where the
    version was published with another digest of its contents."""
    spark = df.sparkSession
    if not re.fullmatch(r"[A-Za-z0-9._-]+", version):
        raise LoadRefused(f"not the name of a version: {version!r}")
    if {"version", "load"} & set(df.columns):
        raise LoadRefused("version and load are columns of the table itself")
    for old in history(spark, root):
        if old["version"] == version and digest is not None and old["digest"] not in (None, digest):
            raise LoadRefused(f"version {version} has another digest: {old['digest']}")
    at = {"version": version, "load": uuid.uuid4().hex[:12], "rows": rows, "digest": digest}
    try:
        marked = df.withColumns({"version": F.lit(version), "load": F.lit(at["load"])})
        marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("version", "load").parquet(f"{root}/data")
        fs, p = filesystem(spark, _folder(root, at))
        have = spark.read.schema(df.schema).parquet(_folder(root, at)).count() if fs.exists(p) else 0
        if have != rows:
            raise LoadRefused(f"version {version} has {have} rows, {rows} were announced")
        if not fs.exists(p):  # a version without rows
            df.limit(0).write.parquet(_folder(root, at))
    except Exception:
        removed(spark, _folder(root, at))
        raise
    return at


def activate(spark: SparkSession, root: str, staged: dict, seen: int) -> bool:
    """Makes a staged load active if `seen` (0: none) is still the largest pointer."""
    jvm = spark.sparkContext._jvm
    fs, draft = filesystem(spark, f"{root}/draft/{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    stream.write(bytearray(json.dumps(staged, sort_keys=True).encode()))
    stream.close()
    target = filesystem(spark, f"{root}/pointer/{seen + 1}")[1]
    fs.mkdirs(target.getParent())
    known = _pointers(spark, root)
    if (known[-1] if known else 0) != seen:
        fs.delete(draft, False)
        return False
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    no_overwrite = spark.sparkContext._gateway.new_array(rename, 1)
    no_overwrite[0] = rename.valueOf("NONE")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(draft, target, no_overwrite)
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in str(e.java_exception.getClass().getName()):
            raise
        fs.delete(draft, False)
        return False
    return True


def publish(df: DataFrame, root: str, version: str, rows: int, digest: str | None = None) -> dict:
    """Stages and activates. Refused if another writer was faster; its load is then removed."""
    spark = df.sparkSession
    now = active(spark, root)
    at = stage(df, root, version, rows, digest)
    if not activate(spark, root, at, now["sequence"] if now else 0):
        removed(spark, _folder(root, at))
        raise LoadRefused(f"another writer changed {root} while version {version} was loaded")
    return active(spark, root)


def roll_back(spark: SparkSession, root: str, sequence: int) -> bool:
    """Makes what an earlier pointer named active again, by a new pointer."""
    old, now = _pointer(spark, root, sequence), active(spark, root)
    return activate(spark, root, {k: v for k, v in old.items() if k != "sequence"}, now["sequence"])


def cleaned(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Removes loads that none of the last `keep` pointers names, those that were never activated among them; returns how many. Not to be run
    while a load is under way."""
    named = {(h["version"], h["load"]) for h in history(spark, root)[-keep:]}
    fs, data = filesystem(spark, f"{root}/data")
    gone = 0
    for v in fs.listStatus(data) if fs.exists(data) else []:
        version = v.getPath().getName().removeprefix("version=")
        for load in fs.listStatus(v.getPath()) if v.isDirectory() else []:
            name = load.getPath().getName()
            if name.startswith("load=") and (version, name.removeprefix("load=")) not in named:
                fs.delete(load.getPath(), True)
                gone += 1
    return gone
