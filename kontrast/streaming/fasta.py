"""A stream of FASTA files: each new file's records, normalised, with a strand or a shuffled control."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alphabet import normalized, reverse_complement
from ..operators.sampling import shuffled


def fasta_stream(spark: SparkSession, path: str) -> DataFrame:
    """(file, definition, sequence) of the records of each file that arrives under ``path``; no state is kept."""
    raw = spark.readStream.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^>", "").alias("value")).where("trim(value) <> ''")
    cut = F.locate("\n", F.col("value"))
    head = F.when(cut > 0, F.substring(F.col("value"), F.lit(1), cut - 1)).otherwise(F.col("value"))
    body = F.when(cut > 0, F.substring(F.col("value"), cut + 1, F.char_length("value"))).otherwise("")
    return raw.select("file", F.rtrim(head).alias("definition"), normalized(F.regexp_replace(body, r"\s", "")).alias("sequence"))


def reverse_strand(records: DataFrame) -> DataFrame:
    return records.withColumn("sequence", reverse_complement(F.col("sequence")))


def shuffled_stream(records: DataFrame, salt: int = 1) -> DataFrame:
    """Each record shuffled with its neighbouring pairs kept; the seed is the salt and the definition."""
    return shuffled(records.withColumn("seq_id", F.col("definition")), salt).drop("seq_id")
