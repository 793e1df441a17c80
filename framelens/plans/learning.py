"""Text features with their SQL, and models, calibration and loops on the labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelens.learning import calibration, features, linear, loops
from framelens.session import table
from framelens.sources.workspace import scratch, small_batches, written

LOW, HIGH, LEAST, MOST, BUCKETS = 3, 5, 3, 5000, 1 << 18
#: Buckets of words and of characters for the models.
SIZE = 1 << 15
FOLDS, INNER = 5, 3
#: Bytes of a row group of vectors. Spark reads up to 4096 rows of a group at once, each column of them as one array of the heap.
GROUP = 8 << 20


def _names(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name")


def char_ngrams(spark, d):
    """Windows of 3 to 5 characters within the words of names: names that have each, and how often it occurs."""
    x = _names(spark, d).select(F.explode(features.counted(features.char_windows(F.col("p_name"), LOW, HIGH))).alias("x"))
    return x.groupBy("x.term").agg(F.count("*").alias("names"), F.sum("x.n").alias("n"))


def char_tfidf(spark, d):
    """Sublinear tf-idf weights at unit length over the most frequent windows."""
    out = features.tfidf(_names(spark, d), "p_partkey", features.char_windows(F.col("p_name"), LOW, HIGH), LEAST, MOST)
    return out.select("p_partkey", "term", F.round("weight", 6).alias("weight"))


def char_hashed(spark, d):
    """Signed buckets of windows at unit length."""
    v = features.hashed(features.counted(features.char_windows(F.col("p_name"), LOW, HIGH)), BUCKETS, signed=True, sublinear=True)
    return _names(spark, d).select("p_partkey", F.explode(v).alias("x")).select("p_partkey", F.col("x.index").alias("bucket"), F.round("x.value", 6).alias("value"))


def vectors(spark, d, name: str, only=None):
    """id, lang, weight, fold (whole sources), part, quality, toxic (null without a label) and packed vector of every document, or of those for which
    `only`, a condition on the labels, holds, as a written table."""
    small_batches(spark)
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    docs = table(spark, d, "documents").join(labels, "doc_id", "left")
    docs = docs if only is None else docs.where(only)
    digit = lambda c, k: F.pmod(F.conv(F.substring(F.md5(c), 1, 7), 16, 10).cast("int"), F.lit(k)).cast("int")
    rows = docs.select(
        F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("und")).alias("lang"), (1.0 + F.col("doc_id") % 4).alias("weight"), digit(F.coalesce("source", F.lit("")), FOLDS).alias("fold"),
        digit(F.concat(F.col("doc_id").cast("string"), F.lit("p")), INNER).alias("part"), "quality", "toxic", "text",
    )
    # the text costs more than its bytes tell: dealt over all cores, however few files it comes from
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return written(features.with_vectors(rows.repartition(tasks), "text", SIZE, HIGH, packed=True), scratch(spark, name), **{"parquet.block.size": GROUP})


def sgd_scores(spark, d):
    """Out-of-fold scores of quality and toxicity by averaged gradient descent with balanced labels, folds of whole sources, all ten models in one run."""
    rows = vectors(spark, d, "sgd", F.col("quality").isNotNull() | F.col("toxic").isNotNull())
    heads = ["quality", "toxic"]
    own = [(FOLDS * h + f, F.when(F.col("fold") != f, F.col(c)), F.col("weight")) for h, c in enumerate(heads) for f in range(FOLDS)]
    ready, _ = linear.balanced(rows.select("id", "vector", linear.tasks(*own).alias("tasks")))
    models = linear.fit_sgd(ready, FOLDS * len(heads), 2 * SIZE, passes=10)
    out = linear.scored(rows, models, only=F.array(*[F.col("fold") + FOLDS * h for h in range(len(heads))]))
    return out.select("id", F.floor(F.col("model") / FOLDS).cast("int").alias("m"), F.round("score", 6).alias("score")).select("id", F.element_at(F.array(*map(F.lit, heads)), F.col("m") + 1).alias("head"), "score")


def calibrated_scores(spark, d):
    """Out-of-fold scores of quality before and after sigmoid calibration within the training folds."""
    rows = vectors(spark, d, "calibrated", F.col("quality").isNotNull()).withColumnRenamed("quality", "label")
    out = calibration.calibrated_oof(rows, 2 * SIZE, FOLDS, scratch(spark, "margins"), INNER, passes=8)
    return out.select("id", "fold", F.round("plain", 6).alias("plain"), F.round("probability", 6).alias("probability"))


def _teachers(rows):
    """Two teachers of toxicity: the label, and the label with some flipped by md5."""
    h = F.substring(F.md5(F.col("id").cast("string")), 1, 1)
    return rows.withColumns({"first": F.col("toxic"), "second": F.when(h > "d", 1 - F.col("toxic")).otherwise(F.col("toxic"))})


def active_rounds(spark, d):
    """Rounds of active learning on the labelled documents, with a random control."""
    rows = _teachers(vectors(spark, d, "active", F.col("toxic").isNotNull()))
    out = loops.active_loop(rows, ["first", "second"], "toxic", 2 * SIZE, scratch(spark, "active-rounds"), loops.Plan(rounds=4, disagree=20, uncertain=20, anchors=10), passes=5)
    return out.select("round", "n_revealed", "n_anchors", "anchor_positives", F.round("anchor_rate", 6).alias("anchor_rate"), F.round("holdout_ap", 6).alias("holdout_ap"), F.round("control_ap", 6).alias("control_ap"), F.round("churn", 6).alias("churn"), "stopped")


def self_training_rounds(spark, d):
    """Rounds in which the model labels the documents without labels itself, and the share of one language among its positives."""
    rows = vectors(spark, d, "self").withColumn("french", F.col("lang") == "fr")
    return loops.self_training(rows, "toxic", 2 * SIZE, scratch(spark, "self-rounds"), rounds=3, low=0.4, high=0.6, group="french", passes=5)


QUERIES = {f.__name__: f for f in (char_ngrams, char_tfidf, char_hashed, sgd_scores, calibrated_scores, active_rounds, self_training_rounds)}
_W = f"""w AS (SELECT p_partkey, unnest(flatten(list_transform(list_filter(string_split_regex(lower(p_name), '\\s+'), lambda x: x <> ''),
  lambda x: flatten(list_transform(list_filter(range({LOW}, {HIGH} + 1), lambda n: n = {LOW} OR n <= length(x) + 2), lambda n: list_transform(range(1, greatest(length(x) + 2 - n + 1, 1) + 1), lambda i: substr(' ' || x || ' ', i, n))))))) AS term FROM part),
c AS (SELECT p_partkey, term, count(*) AS n FROM w GROUP BY 1, 2)"""
ORACLE = {
    "char_ngrams": f"WITH {_W} SELECT term, count(*) AS names, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1",
    "char_tfidf": f"""WITH {_W}, v AS (SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM part)) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM c GROUP BY 1 HAVING count(*) >= {LEAST} ORDER BY sum(n) DESC, term LIMIT {MOST}),
r AS (SELECT p_partkey, term, (1 + ln(n::DOUBLE)) * idf AS w FROM c JOIN v USING (term)) SELECT p_partkey, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY p_partkey)), 6) AS weight FROM r""",
    "char_hashed": f"""WITH {_W}, b AS (SELECT p_partkey, CAST(CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % {BUCKETS} AS INTEGER) AS bucket, sum(CASE WHEN substr(md5(term), 9, 1) < '8' THEN 1 ELSE -1 END * (1 + ln(n::DOUBLE))) AS v FROM c GROUP BY 1, 2)
SELECT p_partkey, bucket, round(v / sqrt(sum(v * v) OVER (PARTITION BY p_partkey)), 6) AS value FROM b WHERE v <> 0""",
}
