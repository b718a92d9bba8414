"""Grouped sequences from the tables: the bases that a document's letters spell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LANGS = ("de", "en", "es", "fr")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(spark: SparkSession, sf_dir: str, by: str = "quality") -> DataFrame:
    """(contrast, set_id, seq_id, rank, definition, sequence).

    by quality: labelled documents, set 0 of quality 1 and set 1 of quality 0; by lang: all, a set for each language;
    by both: labelled, a contrast for each language. Of several labels of a document the largest quality counts.
    """
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    seq = F.regexp_replace(F.lower("text"), "[^acgt]", "")
    base = [F.col("doc_id").alias("seq_id"), F.col("doc_id").alias("rank"), F.concat(F.lit("doc"), F.col("doc_id")).alias("definition"), seq.alias("sequence")]
    if by == "lang":
        order = F.array_position(F.array(*[F.lit(x) for x in LANGS]), F.col("lang")) - 1
        return docs.where(F.col("lang").isin(*LANGS) & F.col("text").isNotNull()).select(F.lit("lang").alias("contrast"), order.cast("int").alias("set_id"), *base)
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality IS NOT NULL")
    both = docs.where("text IS NOT NULL").join(labels, "doc_id")
    contrast = F.col("lang") if by == "both" else F.lit("quality")
    return both.select(contrast.alias("contrast"), (1 - F.col("quality")).cast("int").alias("set_id"), *base)
