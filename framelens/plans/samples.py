"""Stratified draws by hash order, with design weights."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelens.operators import sampling
from framelens.session import table

SEED = "s1"


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")


def hash_draw(spark, d):
    return sampling.draw(_docs(spark, d), "doc_id", SEED, ["lang"], 20).select("lang", "doc_id", F.col("draw").cast("int").alias("draw"))


def hash_draw_weights(spark, d):
    out = sampling.draw(_docs(spark, d), "doc_id", SEED, ["lang"], 20)
    return out.groupBy("lang").agg(F.first("stratum_n").alias("stratum_n"), F.count("*").alias("n"), F.round(F.first("pi"), 9).alias("pi"), F.round(F.sum("weight"), 6).alias("weight_sum"))


def hash_extend_prefix(spark, d):
    """A draw of 20 extended to 50 by the same seed: rows of both, kept and new ones, how many were lost (none), and how many
    weights fell."""
    docs = _docs(spark, d)
    small, large = (sampling.draw(docs, "doc_id", SEED, ["lang"], n).select("lang", "doc_id", F.col("weight").alias(f"w{n}")) for n in (20, 50))
    j = small.join(large, ["lang", "doc_id"], "outer")
    a, b = F.col("w20"), F.col("w50")
    return j.groupBy("lang").agg(F.count("w20").alias("n_old"), F.count_if(a.isNotNull() & b.isNotNull()).alias("n_kept"), F.count_if(a.isNull()).alias("n_new"), F.count_if(b.isNull()).alias("n_lost"), F.count_if(b < a - 1e-9).alias("n_lighter"))


def certainty_sample(spark, d):
    """All of the small strata, 30 of each other; weight is the inverse of the chance."""
    src = _docs(spark, d).withColumn("stratum", F.when(F.col("n_chars") > 8000, F.lit("long")).otherwise(F.col("lang")))
    n = src.groupBy("stratum").agg(F.count("*").alias("stratum_n"))
    rest = sampling.draw(src.where("stratum <> 'long'"), "doc_id", SEED, ["stratum"], 30).select("stratum", "doc_id", "weight")
    return src.where("stratum = 'long'").select("stratum", "doc_id", F.lit(1.0).alias("weight")).unionByName(rest).join(n, "stratum").select("stratum", "doc_id", "stratum_n", F.round("weight", 6).alias("weight"))


def batch_mix(spark, d):
    """50 of largest spread, then 30 most uncertain, then 20 by hash, disjoint."""
    e = table(spark, d, "embeddings").select("vec_id", *[F.round(F.element_at("embedding", i).cast("double"), 6).alias(f"s{i}") for i in (1, 2, 3)])
    s = [F.col(f"s{i}") for i in (1, 2, 3)]
    e = e.select("vec_id", (F.greatest(*s) - F.least(*s)).alias("spread"), F.abs((s[0] + s[1] + s[2]) / 3.0).alias("sure"))
    first = e.orderBy(F.desc("spread"), "vec_id").limit(50).select("vec_id", F.lit("spread").alias("why"))
    left = e.join(first, "vec_id", "left_anti")
    second = left.orderBy("sure", "vec_id").limit(30).select("vec_id", F.lit("uncertain").alias("why"))
    third = left.join(second, "vec_id", "left_anti").orderBy(F.md5(F.concat(F.col("vec_id").cast("string"), F.lit(SEED))), "vec_id").limit(20).select("vec_id", F.lit("hash").alias("why"))
    return first.unionByName(second).unionByName(third)


def chunk_assign(spark, d):
    """Chunks of 25 over a bounded draw."""
    some = sampling.draw(_docs(spark, d), "doc_id", SEED, ["lang"], 40).select("doc_id")
    return sampling.chunks(some, "doc_id", "chunk", 25).select("doc_id", "chunk")


def group_folds(spark, d):
    """Five folds by source, and the same by document, which split sources: sources, documents and split sources of each."""
    docs = _docs(spark, d)
    both = {"by_source": F.col("source"), "by_document": F.col("doc_id").cast("string")}
    f = docs.select("source", F.explode(F.array(*[F.struct(F.lit(n).alias("how"), sampling.group_fold(c, 5).alias("fold")) for n, c in both.items()])).alias("x"))
    g = f.groupBy("x.how", "source").agg(F.count("*").alias("docs"), F.count_distinct("x.fold").alias("folds"))
    return g.groupBy("how").agg(F.count("*").alias("sources"), F.sum("docs").alias("docs"), F.count_if(F.col("folds") > 1).alias("split"))


def group_holdout(spark, d):
    """Sources whose md5 lies in the first quarter are held out together."""
    h = F.substring(F.md5("source"), 1, 2) < "40"
    return _docs(spark, d).groupBy("source").agg(F.max(h).alias("held_out"), F.count("*").alias("docs"))


def fixed_size_parts(spark, d):
    """Parts of exactly 1,000 customers in id order, with their bounds: ranks by range, not one global sort."""
    c = table(spark, d, "customer").select("c_custkey")
    lo = c.agg(F.min("c_custkey").alias("lo"))
    cell = c.join(F.broadcast(lo)).withColumn("cell", F.floor((F.col("c_custkey") - F.col("lo")) / 5000))
    before = cell.groupBy("cell").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("c_custkey")) - 1 + F.col("before")
    return cell.join(before, "cell").select(F.floor(rank / 1000).cast("int").alias("part"), "c_custkey").groupBy("part").agg(F.count("*").alias("rows"), F.min("c_custkey").alias("first"), F.max("c_custkey").alias("last"))


_R = f"r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR) || '{SEED}'), doc_id) AS draw, count(*) OVER (PARTITION BY lang) AS stratum_n FROM documents)"
QUERIES = {f.__name__: f for f in (hash_draw, hash_draw_weights, hash_extend_prefix, certainty_sample, batch_mix, chunk_assign, group_folds, group_holdout, fixed_size_parts)}
_S = "e AS (SELECT vec_id, greatest(a, b, c) - least(a, b, c) AS spread, abs((a + b + c) / 3.0::DOUBLE) AS sure FROM (SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS a, round(embedding[2]::DOUBLE, 6) AS b, round(embedding[3]::DOUBLE, 6) AS c FROM embeddings))"
ORACLE = {
    "hash_draw": f"WITH {_R} SELECT lang, doc_id, CAST(draw AS INTEGER) AS draw FROM r WHERE draw <= 20",
    "hash_draw_weights": f"WITH {_R} SELECT lang, max(stratum_n) AS stratum_n, count(*) AS n, round(least(max(stratum_n), 20)::DOUBLE / max(stratum_n), 9) AS pi, round(count(*) * (max(stratum_n) / least(max(stratum_n), 20)::DOUBLE), 6) AS weight_sum FROM r WHERE draw <= 20 GROUP BY lang",
    "hash_extend_prefix": f"WITH {_R} SELECT lang, count(*) FILTER (WHERE draw <= 20) AS n_old, count(*) FILTER (WHERE draw <= 20) AS n_kept, count(*) FILTER (WHERE draw BETWEEN 21 AND 50) AS n_new, CAST(0 AS BIGINT) AS n_lost, count(*) FILTER (WHERE draw <= 20 AND stratum_n > 20) AS n_lighter FROM r WHERE draw <= 50 GROUP BY 1",
    "certainty_sample": f"""WITH s AS (SELECT doc_id, CASE WHEN n_chars > 8000 THEN 'long' ELSE lang END AS stratum FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(CAST(doc_id AS VARCHAR) || '{SEED}'), doc_id) AS k, count(*) OVER (PARTITION BY stratum) AS stratum_n FROM s)
SELECT stratum, doc_id, stratum_n, CASE WHEN stratum = 'long' THEN 1.0::DOUBLE ELSE round(stratum_n / least(stratum_n, 30)::DOUBLE, 6) END AS weight FROM r WHERE stratum = 'long' OR k <= 30""",
    "batch_mix": f"""WITH {_S}, a AS (SELECT vec_id FROM e ORDER BY spread DESC, vec_id LIMIT 50), b AS (SELECT vec_id FROM e WHERE vec_id NOT IN (SELECT vec_id FROM a) ORDER BY sure, vec_id LIMIT 30),
c AS (SELECT vec_id FROM e WHERE vec_id NOT IN (SELECT vec_id FROM a UNION ALL SELECT vec_id FROM b) ORDER BY md5(CAST(vec_id AS VARCHAR) || '{SEED}'), vec_id LIMIT 20)
SELECT vec_id, 'spread' AS why FROM a UNION ALL SELECT vec_id, 'uncertain' FROM b UNION ALL SELECT vec_id, 'hash' FROM c""",
    "chunk_assign": f"WITH {_R} SELECT doc_id, CAST((row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || 'chunk'), doc_id) - 1) // 25 + 1 AS INTEGER) AS chunk FROM r WHERE draw <= 40",
    "group_folds": "WITH f AS (SELECT source, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 5 AS fold FROM documents), g AS (SELECT source, count(*) AS docs, count(DISTINCT fold) AS folds FROM f GROUP BY 1) SELECT 'by_source' AS how, count(*) AS sources, CAST(sum(docs) AS BIGINT) AS docs, CAST(0 AS BIGINT) AS split FROM g UNION ALL SELECT 'by_document', count(*), CAST(sum(docs) AS BIGINT), count(*) FILTER (WHERE folds > 1) FROM g",
    "group_holdout": "SELECT source, bool_or(substr(md5(source), 1, 2) < '40') AS held_out, count(*) AS docs FROM documents GROUP BY 1",
    "fixed_size_parts": "SELECT part, count(*) AS rows, min(c_custkey) AS first, max(c_custkey) AS last FROM (SELECT c_custkey, CAST((row_number() OVER (ORDER BY c_custkey) - 1) // 1000 AS INTEGER) AS part FROM customer) GROUP BY 1",
}
