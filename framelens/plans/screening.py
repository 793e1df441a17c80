"""Chunks of records repaired from what attempts gave back: accepted attempts and the quarantine."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelens.functions import text as T
from framelens.operators import salvage
from framelens.session import table

RECORD = "id string, note string"
ATTEMPTS = 3


def _digit(seed: str):
    return F.conv(F.substring(F.md5(F.concat_ws("-", F.col("chunk").cast("string"), F.lit(seed), *([F.col("attempt").cast("string")] if seed == "o" else []))), 1, 1), 16, 10).cast("int")


def _round(spark, d):
    """Expected ids of chunks of 20 documents, chunks that exist, and outputs: the text of a document, an array of the chunk's records with or
    without a fault by a digit of an md5, and the text again."""
    docs = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 20).alias("chunk"), "doc_id", "text")
    expected = docs.select("chunk", F.concat(F.lit("W"), F.col("doc_id").cast("string")).alias("id"))
    chunks = docs.groupBy("chunk").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"), F.min_by("text", "doc_id").alias("text"))
    record = lambda head, x: F.struct(F.concat(F.lit(head), x.cast("string")).alias("id"), F.lit('a ] [ "quoted" [1]').alias("note"))
    chunks = chunks.select("chunk", "text", F.transform("ids", lambda x: record("W", x)).alias("good"), F.col("ids")[0].alias("first"))
    existing = T.once(chunks.select("chunk", "good"), "d", _digit("e")).select("chunk", F.when(F.col("d") < 2, F.to_json("good")).when(F.col("d") == 2, "{}").when(F.col("d") == 3, "[cut").alias("json"))
    o = T.once(chunks.withColumn("attempt", F.explode(F.array(*[F.lit(k) for k in range(1, ATTEMPTS + 2)]))), "d", _digit("o"))
    rest = F.slice("good", 2, F.size("good"))
    made = (
        F.when(F.col("d") < 5, F.to_json(rest)).when(F.col("d") < 8, F.to_json(F.concat("good", F.slice("good", 1, 1))))
        .when(F.col("d") < 10, F.to_json(F.concat(F.array(record("X", F.col("first"))), rest))).when(F.col("d") == 10, F.concat(F.lit("[["), F.to_json("good"), F.lit(" x")))
        .when(F.col("d") == 11, F.lit("nothing")).otherwise(F.to_json("good"))
    )
    stream = F.when(F.col("d") % 2 == 0, "response").otherwise("stdout")
    planted = F.struct(stream.alias("stream"), F.concat_ws("\n", F.coalesce("text", F.lit("")), made, F.coalesce("text", F.lit(""))).alias("text"))
    errors = F.struct(F.lit("stderr").alias("stream"), F.lit('warning: ["no record"]').alias("text"))
    return expected, existing, o.select("chunk", "attempt", F.explode(F.array(planted, errors)).alias("x")).select("chunk", "attempt", "x.*")


def _rules(records):
    return {"schema_violation": F.forall(records, lambda r: r["note"].isNotNull())}


def chunk_repair(spark, d):
    """For each chunk the attempt that was accepted, 0 if it was there before, none if all failed, and the candidates that were tried."""
    accepted, _ = salvage.repair(*_round(spark, d), _rules, RECORD, ATTEMPTS)
    return accepted.select("chunk", "attempt", "stream", "position", "tried", F.sha2("candidate", 256).alias("sha256"))


def chunk_quarantine(spark, d):
    """What was set aside, by attempt, stream and code."""
    _, aside = salvage.repair(*_round(spark, d), _rules, RECORD, ATTEMPTS)
    return aside.select("attempt", "stream", F.explode("codes").alias("code")).groupBy("attempt", "stream", "code").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (chunk_repair, chunk_quarantine)}

# tries of an attempt in their order: stdout, stderr, response
_TRIES = r"""
c AS (SELECT doc_id // 20 AS chunk, count(*) AS n, min(doc_id) AS first,
             '[' || string_agg('{"id":"W' || doc_id || '","note":"a ] [ \"quoted\" [1]"}', ',' ORDER BY doc_id) || ']' AS good FROM documents GROUP BY 1),
e AS (SELECT chunk, n, good, CAST('0x' || substr(md5(chunk || '-e'), 1, 1) AS INTEGER) AS d FROM c),
o AS (SELECT chunk, n, good, a AS attempt, CAST('0x' || substr(md5(chunk || '-o-' || a), 1, 1) AS INTEGER) AS d FROM c, (SELECT unnest([1, 2, 3]) AS a)),
t AS (SELECT chunk, 0 AS attempt, 0 AS s, 'existing' AS stream, good, CASE WHEN d < 2 THEN [] WHEN d = 2 THEN ['not_array'] ELSE ['invalid_json'] END AS codes FROM e WHERE d < 4
      UNION ALL SELECT chunk, attempt, 2, 'stderr', good, ['invalid_record'] FROM o
      UNION ALL SELECT chunk, attempt, CASE WHEN d % 2 = 0 THEN 3 ELSE 1 END, CASE WHEN d % 2 = 0 THEN 'response' ELSE 'stdout' END, good,
        CASE WHEN d < 5 THEN ['wrong_count', 'wrong_id_set'] WHEN d < 8 THEN ['wrong_count', 'duplicate_id'] WHEN d < 10 THEN ['malformed_id', 'wrong_id_set'] ELSE [] END FROM o WHERE d <> 11),
r AS (SELECT *, coalesce(max(CAST(len(codes) = 0 AS INTEGER)) OVER (PARTITION BY chunk ORDER BY attempt, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM t),
u AS (SELECT * FROM r WHERE done = 0)"""
ORACLE = {
    "chunk_repair": f"""WITH {_TRIES}
SELECT c.chunk, max(attempt) FILTER (WHERE len(codes) = 0) AS attempt, max(stream) FILTER (WHERE len(codes) = 0) AS stream,
       CASE WHEN max(attempt) FILTER (WHERE len(codes) = 0) IS NOT NULL THEN 0 END AS position, count(u.chunk) AS tried,
       sha256(max(u.good) FILTER (WHERE len(codes) = 0)) AS sha256 FROM c LEFT JOIN u ON c.chunk = u.chunk GROUP BY 1""",
    "chunk_quarantine": f"WITH {_TRIES} SELECT attempt, stream, code, count(*) AS n FROM (SELECT attempt, stream, unnest(codes) AS code FROM u WHERE len(codes) > 0) GROUP BY 1, 2, 3",
}
