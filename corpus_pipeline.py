"""A pipeline over documents; each stage applies one operator of the llm subpackage and its decisions take effect."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kontrast.llm.common import deleted, read, recording, release, stored
from kontrast.llm.decontamination import contamination
from kontrast.llm.jaccard_join import link
from kontrast.llm.line_dedup import drop_repeated_lines
from kontrast.llm.mixing import mix
from kontrast.llm.quality import classify

_left: list[str] = []


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """What a stage has stored is deleted when the next one begins, as the result has been written and reread by then."""

    @functools.wraps(f)
    def run_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for path in _left:
            deleted(spark, path)
        _left.clear()
        with recording() as made:
            out = f(spark, docs, sf_dir)
        _left.extend(made)
        return out

    return run_


def row_key() -> Column:
    """A name for a row by its id and text: rows without an id, and texts that share one, are told apart."""
    return F.xxhash64("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("text").isNull())


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts have weight 1; rows that repeat id and text fare alike.

    The Gumbel noise is scaled to a tenth, as a filter should lose few clean texts to the draw.
    """
    return classify(docs, read(spark, sf_dir, "labels"), temperature=0.1, keep=tuple(docs.columns)).where("kept").select(*docs.columns)


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents of which only blanks remain; n_chars follows the text. Null and empty texts stay."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    out = drop_repeated_lines(docs, keep=rest).where("n_dropped = 0 OR text RLIKE '[^\\\\s]'")
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share 0.8 of their five-word shingles, that of smallest id stays.

    Rows without an id are judged too, and come last in their group. Of rows that repeat id and text one stays; rows that
    repeat only the id are judged each by its text. Null, empty and blank texts are like no other.
    """
    named = docs.withColumn("__key", row_key())
    linked = link(named.select(F.col("__key").alias("doc_id"), "text"), width=5, percent=80).select(F.col("doc_id").alias("__key"), "component_id")
    ids = named.select("__key", F.col("doc_id").isNull().alias("last"), "doc_id").join(linked, "__key")
    first = ids.groupBy("component_id").agg(F.min(F.struct("last", "doc_id", "__key")).alias("x")).select("x.__key")
    kept = named.join(first, "__key", "left_semi")
    keys = linked.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("__key").alias("d")).first()
    return (kept if keys["n"] == keys["d"] else kept.dropDuplicates(["__key"])).drop("__key")


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go, each by its own text, also without an id. Null and empty texts stay."""
    named = docs.withColumn("__key", row_key())
    found = contamination(named.select(F.col("__key").alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"), slop=0)
    return named.join(found.where("contaminated").select(F.col("doc_id").alias("__key")), "__key", "left_anti").drop("__key")


@stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken, text): what the mix takes of each document.

    Null and empty texts have size 0 and are never taken; a null source is one of its own; repeated rows are mixed each.
    """
    return mix(docs, keep=("text",))


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", line_dedup),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: The classifier's model and the mix's Newton steps have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    before = None
    for name, f in STAGES[:-1]:
        docs = stored(f(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
