"""A corpus pipeline over `documents`: toxicity, line dedup, near-dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows to the
shared folder as Parquet and reads them back as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm import bpe, decontam, lines, minhash, toxicity
from kbspark.llm.common import cut, table

ORACLE_SQL = None  #: SQL cannot express the stages


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model does not reject (rows of one doc_id go by their own text)."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    return toxicity.keep_clean(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of templates that recur across documents."""
    return lines.drop_lines(docs).select(*docs.columns).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def row_keys(docs: DataFrame) -> DataFrame:
    """key, text, row: each row in one struct (so no column's name can clash), under its doc_id, or under a hash of id and text
    where the id is null or has different texts."""
    packed = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    text = F.xxhash64("text")
    several = packed.where("doc_id is not null").groupBy("doc_id").agg(F.min(text).alias("x"), F.max(text).alias("y")).where("x <> y")
    several = cut(several.select("doc_id", F.lit(True).alias("several")), "several-texts")
    own = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2).bitwiseOR(F.lit(1 << 62))  # beyond all ids
    key = F.when(F.col("doc_id").isNull() | F.col("several"), own).otherwise(F.col("doc_id"))
    return packed.join(several, "doc_id", "left").select(key.alias("key"), "text", "row")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group.

    Rows without a doc_id go by their text. Rows of one id and text are one document; of them the row whose JSON is smallest
    stays. Null and empty texts are near nothing; texts of any length count in whole; other columns go along, whatever their names and types.
    """
    rows = row_keys(docs)
    kept = minhash.near_duplicates(rows.select(F.col("key").alias("doc_id"), "text")).where("kept").groupBy(F.col("doc_id").alias("key")).agg(F.count("*").alias("n"))
    left = cut(rows.drop("text").join(kept, "key"), "kept-rows")
    again = left.where("n > 1").groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return left.where("n = 1").select("row.*").unionByName(again.select("row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that cover no benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of what is left."""
    import public_tokenizers

    return bpe.encode_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
