"""The corpus pipeline: toxicity, line dedup, near-duplicate join, source mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows to the shared
folder and gives them to the next. All but the last return the columns of documents. Defined cases are those
of the operators: empty tables stay empty through all stages, rows that repeat a doc_id stay apart.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelens.llm import bpe, line_dedup, mixing, ngram_join, toxicity
from framelens.llm.common import join_small, keyed, paths, remove, small_batches, written

TOKENIZER = "byte_bpe_multi_50k.tiktoken"

#: The lexicon is learned from labels and folds hash blocks in Python: no SQL form.
ORACLE_SQL = None


def _kept_aside(docs: DataFrame, *more, leave: tuple[str, ...] = ()) -> DataFrame:
    """Each row, but what is to be left out, as the struct _row, so that none of its columns meets those of a stage, and the
    columns that the stage needs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in leave]).alias("_row"), *more)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fitted model calls toxic go."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    return toxicity.score(_kept_aside(docs, "text"), model).where("predicted = 0").select("_row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go; n_chars follows the text. A document that loses all lines stays, empty."""
    cols = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    out = line_dedup.dedup_lines(_kept_aside(docs, "doc_id", "text", leave=tuple(cols)))
    return out.select(*[(cols[c] if c in cols else F.col("_row")[c]).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays, that of smallest id. Rows are known by id and text, as ids may
    repeat; of rows that repeat both, which are copies, any one stays."""
    found = written(ngram_join.near_duplicates(docs.select("doc_id", "text")).select(keyed().alias("_id"), F.col("text_hash").alias("_tx"), "is_first"), "near-copies")
    key = ["_id", "_tx"]
    others = written(found.where("NOT is_first").select(*key).distinct(), "other-copies")
    rows = _kept_aside(docs, keyed().alias("_id"), ngram_join.row_hash(F.col("text")).alias("_tx"))
    out = join_small(rows, others, key, "left_anti")
    if not found.where("is_first").groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        out = out.dropDuplicates(key)
    return out.select("_row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix: the files of the result follow each other slot by slot."""
    order = mixing.mix(docs.select("doc_id", "source")).groupBy(keyed().alias("_id")).agg(F.min(F.struct("slot", "place")).alias("_at"))
    out = _kept_aside(docs, keyed().alias("_id")).join(order, "_id", "left")
    return out.repartitionByRange("_at").sortWithinPartitions("_at").select("_row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document."""
    return bpe.encode_decode(docs.select("doc_id", "text"), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN, digests_only=True)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("ngram_jaccard", drop_near_copies), ("source_mixing", mix_sources), ("byte_bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. When a stage is written, what it has left in the shared folder goes, and so does the stage before it."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        before = set(paths())
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        made = [p for p in paths() if p not in before]
        remove(spark, made[:-1] + last)
        last = made[-1:]
    return docs
