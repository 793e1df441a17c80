"""Published forms, contracts, upserts and salvage."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelens.functions import text as T
from framelens.operators import contracts as C
from framelens.session import table
from framelens.sources.workspace import scratch, written


def quantize_pack(spark, d):
    s = F.transform(F.slice("embedding", 1, 4), lambda x: F.round(F.abs(x.cast("double")), 4))
    return table(spark, d, "embeddings").select("vec_id", T.packed_scores(s).alias("packed"))


def pg_arrays(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("f"))
    return li.select("l_orderkey", T.pg_array(F.col("f")).alias("flags"))


def permalinks(spark, d):
    """Short digest of a canonical filter."""
    canonical = F.concat(F.lit('{"brand":"'), F.col("p_brand"), F.lit('","size":'), F.col("p_size").cast("string"), F.lit("}"))
    return table(spark, d, "part").select("p_brand", "p_size").distinct().select("p_brand", "p_size", F.substring(F.sha2(canonical, 256), 1, 16).alias("hash"))


def id_digest(spark, d):
    """Order-free digest of a set of ids by part: the sum of the numbers in their md5."""
    h = F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 8), 16, 10).cast("long")
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum(h).alias("digest"))


def contract_violations(spark, d):
    """Codes of broken rules by event type; JSON that doesn't parse breaks its rule."""
    e = table(spark, d, "events").select("event_id", "event_type", "user_id", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    rules = {"bad_type": F.col("event_type").isin("click", "view", "purchase"), "bad_value": F.col("value").between(0, 100), "bad_props": F.col("k") < 90}
    bad = e.select("event_type", F.explode(C.codes(rules)).alias("code"))
    return bad.groupBy("event_type", "code").agg(F.count("*").alias("n"))


def chunk_contract(spark, d):
    """Each conversation is a chunk: turns must be unique, start at 0, have both roles and no empty text."""
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.count_distinct("turn").alias("turns"), F.min("turn").alias("first"), F.count_distinct("role").alias("roles"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("blank"))
    rules = {"duplicate_turn": F.col("n") == F.col("turns"), "bad_start": F.col("first") == 0, "one_sided": F.col("roles") >= 2, "blank_text": F.col("blank") == 0, "wrong_count": F.col("n").between(2, 6)}
    return g.select("conv_id", F.array_join(C.codes(rules), ",").alias("codes")).where("codes <> ''")


def fk_orphans(spark, d):
    child = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return C.orphans(child, table(spark, d, "customer").where("c_custkey % 50 <> 0"), "c_custkey").select("o_orderkey")


def check_enum(spark, d):
    return C.outside(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O"]).select("o_orderkey", "o_orderstatus")


def unique_active(spark, d):
    return C.more_than_one(table(spark, d, "supplier"), F.col("s_acctbal") > 0, ["s_nationkey"])


def upsert_last_wins(spark, d):
    """State after the first 15 days, upserted with the rest."""
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", F.round("value", 4).alias("value")).withColumn("version", F.struct("ts", "event_id"))
    part = lambda c: e.where(c).groupBy("user_id", "event_type").agg(F.max_by(F.struct("version", "value"), "version").alias("r")).select("user_id", "event_type", "r.*")
    day = F.dayofmonth("ts")
    return C.upsert(part(day <= 15), part(day > 15), ["user_id", "event_type"], "version").select("user_id", "event_type", "value")


def recent_window_sync(spark, d):
    """What the streaming merge keeps: last value, first and last time seen."""
    from framelens.streaming.sync import latest

    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts").withColumns({"first_seen": F.col("ts"), "last_seen": F.col("ts")})
    return latest(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", F.col("first_seen").cast("string").alias("first_seen"), F.col("last_seen").cast("string").alias("last_seen"))


def filter_agg(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.round(F.sum(F.when(F.col("l_tax") > 0.04, F.col("l_quantity"))), 2).alias("taxed"), F.count("*").alias("n"))


def facet_tables(spark, d):
    o = table(spark, d, "orders").select(F.explode(F.array(F.struct(F.lit("status").alias("facet"), F.col("o_orderstatus").alias("value")), F.struct(F.lit("priority").alias("facet"), F.col("o_orderpriority").alias("value")))).alias("x"))
    return o.groupBy("x.facet", "x.value").agg(F.count("*").cast("int").alias("works"))


def replace_columns(spark, d):
    """All columns but one, with one replaced in its place and a constant version."""
    c = table(spark, d, "customer").drop("c_acctbal")
    return c.withColumns({"c_mktsegment": F.lower("c_mktsegment"), "version": F.lit("v1")})


def nested_export(spark, d):
    """Works with their members, a JSON document each."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("place")))).alias("members"))
    return li.select("l_orderkey", F.to_json(F.struct(F.col("l_orderkey").alias("id"), "members")).alias("document"))


FOLDS = 5


def tfidf_logreg(spark, d):
    """Out-of-fold scores of hashed tf-idf of words and word pairs and a logistic model with balanced classes, five folds by
    source; a fold whose training rows have one class gets that class. Rows only: numbers depend on the solver."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, NGram, Normalizer, RegexTokenizer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    data = table(spark, d, "documents").select("doc_id", "text", "source").join(table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    data = data.withColumn("fold", F.pmod(F.conv(F.substring(F.md5("source"), 1, 4), 16, 10).cast("int"), F.lit(FOLDS)))
    # counts don't depend on the fold: texts are split and hashed once, and every pass of every fold reads the counts
    steps = [RegexTokenizer(inputCol="text", outputCol="w1", pattern=r"\W+"), NGram(n=2, inputCol="w1", outputCol="w2")]
    steps += [HashingTF(inputCol=w, outputCol=f"{w}_tf", numFeatures=1 << 15) for w in ("w1", "w2")]
    steps += [VectorAssembler(inputCols=["w1_tf", "w2_tf"], outputCol="tf")]
    for step in steps:
        data = step.transform(data)
    data = written(data.select("doc_id", "fold", "label", "tf"), scratch(spark, "tf"))
    counts = {(r["fold"], r["label"]): r["count"] for r in data.groupBy("fold", "label").count().collect()}
    out = None
    for k in sorted({f for f, _ in counts}):  # the vocabulary weights are fitted without the fold they score
        n = {y: sum(c for (f, z), c in counts.items() if f != k and z == y) for y in (0.0, 1.0)}
        train, test = data.where(F.col("fold") != k), data.where(F.col("fold") == k)
        if not all(n.values()):
            got = test.select("doc_id", "fold", F.lit(float(n[1.0] > 0)).alias("score"))
        else:
            fold = [IDF(inputCol="tf", outputCol="both", minDocFreq=2), Normalizer(inputCol="both", outputCol="features"), LogisticRegression(maxIter=10, regParam=0.01, weightCol="balance")]
            balance = F.when(F.col("label") == 1, sum(n.values()) / (2 * n[1.0])).otherwise(sum(n.values()) / (2 * n[0.0]))
            got = Pipeline(stages=fold).fit(train.withColumn("balance", balance)).transform(test).select("doc_id", "fold", vector_to_array("probability")[1].alias("score"))
        out = got if out is None else out.unionByName(got)
    return out


QUERIES = {f.__name__: f for f in (quantize_pack, pg_arrays, permalinks, id_digest, contract_violations, chunk_contract, fk_orphans, check_enum, unique_active, upsert_last_wins, recent_window_sync, filter_agg, facet_tables, replace_columns, nested_export, tfidf_logreg)}
_HEX = "lpad(lower(to_hex(CAST(floor(v * 65535.0::DOUBLE + 0.5::DOUBLE) AS BIGINT))), 4, '0')"
ORACLE = {
    "quantize_pack": f"WITH x AS (SELECT vec_id, i, round(abs(embedding[i]::DOUBLE), 4) AS v FROM embeddings, (VALUES (1), (2), (3), (4)) AS t(i)) SELECT vec_id, CASE WHEN max(v) <= 1 THEN string_agg(substr({_HEX}, 3, 2) || substr({_HEX}, 1, 2), '' ORDER BY i) END AS packed FROM x GROUP BY 1",
    "pg_arrays": "SELECT l_orderkey, '{' || string_agg(DISTINCT '\"' || l_returnflag || '\"', ',' ORDER BY '\"' || l_returnflag || '\"') || '}' AS flags FROM lineitem GROUP BY 1",
    "permalinks": "SELECT DISTINCT p_brand, p_size, substr(sha256('{\"brand\":\"' || p_brand || '\",\"size\":' || CAST(p_size AS VARCHAR) || '}'), 1, 16) AS hash FROM part",
    "id_digest": "SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT)) AS BIGINT) AS digest FROM orders GROUP BY 1",
    "contract_violations": "WITH e AS (SELECT event_type, value, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events), b AS (SELECT event_type, 'bad_type' AS code FROM e WHERE NOT coalesce(event_type IN ('click', 'view', 'purchase'), FALSE) UNION ALL SELECT event_type, 'bad_value' FROM e WHERE NOT coalesce(value BETWEEN 0 AND 100, FALSE) UNION ALL SELECT event_type, 'bad_props' FROM e WHERE NOT coalesce(k < 90, FALSE)) SELECT event_type, code, count(*) AS n FROM b GROUP BY 1, 2",
    "chunk_contract": "WITH g AS (SELECT conv_id, count(*) AS n, count(DISTINCT turn) AS turns, min(turn) AS first, count(DISTINCT role) AS roles, count(*) FILTER (WHERE coalesce(trim(text), '') = '') AS blank FROM conversations GROUP BY 1), c AS (SELECT conv_id, concat_ws(',', CASE WHEN n <> turns THEN 'duplicate_turn' END, CASE WHEN first <> 0 THEN 'bad_start' END, CASE WHEN roles < 2 THEN 'one_sided' END, CASE WHEN blank <> 0 THEN 'blank_text' END, CASE WHEN n NOT BETWEEN 2 AND 6 THEN 'wrong_count' END) AS codes FROM g) SELECT * FROM c WHERE codes <> ''",
    "fk_orphans": "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 0)",
    "check_enum": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('F', 'O')",
    "unique_active": "SELECT s_nationkey, count(*) AS active FROM supplier WHERE s_acctbal > 0 GROUP BY 1 HAVING count(*) > 1",
    "upsert_last_wins": "SELECT user_id, event_type, round(value, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
    "recent_window_sync": "SELECT user_id, last(event_type ORDER BY ts, event_id) AS event_type, CAST(min(ts) AS VARCHAR) AS first_seen, CAST(max(ts) AS VARCHAR) AS last_seen FROM events GROUP BY 1",
    "nested_export": "SELECT l_orderkey, '{\"id\":' || l_orderkey || ',\"members\":[' || string_agg('{\"line\":' || l_linenumber || ',\"place\":' || l_suppkey || '}', ',' ORDER BY l_linenumber, l_suppkey) || ']}' AS document FROM lineitem GROUP BY 1",
    "filter_agg": "SELECT l_returnflag, count(*) FILTER (WHERE l_discount > 0.05::DOUBLE) AS discounted, round(sum(l_quantity) FILTER (WHERE l_tax > 0.04::DOUBLE), 2) AS taxed, count(*) AS n FROM lineitem GROUP BY 1",
    "facet_tables": "SELECT 'status' AS facet, o_orderstatus AS value, CAST(count(*) AS INTEGER) AS works FROM orders GROUP BY 2 UNION ALL SELECT 'priority', o_orderpriority, CAST(count(*) AS INTEGER) FROM orders GROUP BY 2",
    "replace_columns": "SELECT c_custkey, c_name, c_nationkey, lower(c_mktsegment) AS c_mktsegment, 'v1' AS version FROM customer",
}
