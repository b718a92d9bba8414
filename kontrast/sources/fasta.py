"""FASTA files, plain or compressed, read and written by Spark's text source and sink."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.alphabet import LETTERS, normalized, reverse_complement

_own: str | None = None


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    global _own
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/kontrast-tables"
    if not base:
        if _own is None:
            _own = tempfile.mkdtemp(prefix="kontrast-")
            atexit.register(shutil.rmtree, _own, True)
        base = _own
    return f"{base}/{name}-{uuid.uuid4().hex}"


def read_fasta(spark: SparkSession, path: str, n_seq: int | None = None, both_strands: bool = False, check: bool = True) -> DataFrame:
    """(rank, definition, sequence) of each record under ``path`` (.gz and .bz2 too), lower case, u read as t.

    Records end where a line begins with ``>``; rank is the order over the files by name. A text split is cut into
    records by Spark, and records are counted by split before they are numbered, so no file is numbered in one task.
    ``n_seq`` keeps the first so many. With ``check`` a residue outside the IUPAC codes is an error.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    raw = raw.withColumn("value", F.regexp_replace("value", "^>", "")).where("trim(value) <> ''")
    cut = F.locate("\n", F.col("value"))
    head = F.when(cut > 0, F.substring(F.col("value"), F.lit(1), cut - 1)).otherwise(F.col("value"))
    body = F.when(cut > 0, F.substring(F.col("value"), cut + 1, F.char_length("value"))).otherwise("")
    rows = raw.select("file", "block", "at", F.rtrim(F.regexp_replace(head, "\r", "")).alias("definition"), normalized(F.regexp_replace(body, r"\s", "")).alias("sequence"))
    if check:
        fine = F.regexp_like("sequence", F.lit(f"^[{LETTERS}-]*$"))
        rows = rows.withColumn("sequence", F.when(fine, F.col("sequence")).otherwise(F.raise_error(F.concat(F.lit("no nucleotide sequence: "), "definition"))))
    blocks = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("at"))
    rows = rows.withColumn("place", inside).join(F.broadcast(blocks.drop("n")), ["file", "block"])
    out = rows.select((F.col("before") + F.col("place") - 1).alias("rank"), "definition", "sequence")
    if n_seq:
        out = out.where(F.col("rank") < n_seq)
    return out.withColumn("sequence", F.concat("sequence", F.lit("$"), reverse_complement(F.col("sequence")))) if both_strands else out


def write_fasta(seqs: DataFrame, path: str, compression: str | None = None, width: int = 80) -> None:
    """Records (definition, sequence) in the order of ``rank``, with lines of ``width`` residues; parts are ordered by name."""
    lines = F.regexp_replace("sequence", f"(.{{{width}}})(?=.)", "$1\n")
    out = seqs.repartitionByRange(max(1, int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "rank").sortWithinPartitions("rank")
    out = out.select(F.concat(F.lit(">"), "definition", F.lit("\n"), lines).alias("value"))
    (out.write.option("compression", compression) if compression else out.write).text(path)


def read_matrix(spark: SparkSession, path: str, tolerance: float = 1e-5) -> DataFrame:
    """(pos, a, c, g, t) of an emission matrix: after a header, lines of an index and four numbers that sum to 1.

    Other lines are left out; with four numbers alone the line's place in the file is its index.
    """
    parts = F.split(F.trim("value"), r"[\s,]+")
    rows = spark.read.text(path).withColumn("x", parts).where(F.size("x") >= 4).withColumn("at", F.monotonically_increasing_id())
    n = F.size("x")
    num = [F.try_element_at("x", F.lit(i - 4)).try_cast("double").alias(b) for i, b in enumerate("acgt")]
    rows = rows.select(F.when(n >= 5, F.element_at("x", 1).try_cast("int")).alias("given"), "at", *num)
    rows = rows.where(F.abs(F.col("a") + F.col("c") + F.col("g") + F.col("t") - 1) <= tolerance)
    place = F.row_number().over(Window.orderBy("at")) - 1
    return rows.select(F.coalesce("given", place).cast("int").alias("pos"), "a", "c", "g", "t")
