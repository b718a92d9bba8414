"""What the operators of this subpackage share: reading, stored intermediates, word hashes."""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None
_recorders: list[list[str]] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of the input folder; Arrow batches are kept short, since one row can hold a huge text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or else the warehouse; in local mode a temporary one."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        return f"{spark.conf.get('spark.sql.warehouse.dir')}/kontrast-tables"
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="kontrast-")
        atexit.register(shutil.rmtree, _own_dir, True)
    return _own_dir


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _recorders:
        made.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.stored_at = path
    return out


def deleted(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing will read again."""
    for df in tables:
        deleted(df.sparkSession, df.stored_at)


@contextlib.contextmanager
def recording() -> Iterator[list[str]]:
    """The paths of all that is stored meanwhile, so that it can be deleted once the result has been written."""
    made: list[str] = []
    _recorders.append(made)
    try:
        yield made
    finally:
        _recorders.remove(made)


def swept(spark: SparkSession) -> None:
    """Lets the session drop shuffles that nothing uses any more; long jobs would pile them up on the disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slices(spark: SparkSession, n: int) -> int:
    """Number of partitions for n units of work of which each partition may hold one, at least the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), n)


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Words of ASCII-lowered texts, split at space and \\t-\\r: a 64-bit hash for each, and the offsets of the texts.

    ``bytes.lower`` and ``bytes.split`` act on ASCII only, which is exactly the split wanted here.
    """
    words: list[bytes] = []
    ends = np.zeros(len(texts) + 1, np.int64)
    for i, t in enumerate(texts):
        if t:
            words += t.encode().lower().split()
        ends[i + 1] = len(words)
    return hash_words(words), ends


def hash_words(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, computed once for each distinct word."""
    if not words:
        return np.zeros(0, np.uint64)
    coded = pa.array(words, pa.large_binary()).dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in distinct), np.uint64, len(distinct))[coded.indices.to_numpy()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


SALTS = 16


def salted_join(left: DataFrame, right: DataFrame, on: list[str], spread: str, how: str = "inner") -> DataFrame:
    """An equi-join whose left side may hold very many rows of one key: they are dealt over SALTS parts by ``spread``.

    The right side, which must have few rows a key, is repeated for each part.
    """
    salt = F.pmod(F.xxhash64(spread, F.lit(3)), F.lit(SALTS)).cast("int").alias("__salt")
    right = right.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    return left.select("*", salt).join(right, [*on, "__salt"], how).drop("__salt")


#: Edges that one task joins in memory.
TASK_EDGES = 500_000


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of the edges from ``a`` to ``b``, and for each the smallest node that it can reach."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    least = np.arange(len(node))
    while True:
        low, new = np.minimum(least[x], least[y]), least.copy()
        np.minimum.at(new, least[x], low)
        np.minimum.at(new, least[y], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == least).all():
            return node, node[least]
        least = new


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of the stored table ``edges`` (a, b), longs: the smallest node that each can reach.

    Up to TASK_EDGES edges are joined by one task. More take alternating large-star and small-star steps, each a grouped
    minimum and a join, until the edges are stars around smallest nodes; edges and labels stay in stored tables.
    """

    def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if got := list(batches):
            a, b = (np.concatenate([x.column(c).to_numpy() for x in got]) for c in ("a", "b"))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in least_reachable(a, b)], names=["node", "component"])

    if edges.count() <= TASK_EDGES:
        return edges.select("a", "b").coalesce(1).mapInArrow(at_once, "node long, component long")

    def step(e: DataFrame, large: bool) -> DataFrame:
        ends = e.select("a", "b").union(e.select(F.col("b"), F.col("a"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = ends.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        both = salted_join(ends, least, ["a"], "b")
        if large:
            out = both.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = both.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return stored(out.where("a != b").distinct(), "edges")

    def ended(e: DataFrame) -> bool:
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("b", F.lit(0), F.lit(1)))
        return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up > 0 AND down > 0").isEmpty()

    e = edges
    while True:
        middle = step(e, True)
        after = step(middle, False)
        release(middle, *([e] if e is not edges else []))
        e = after
        if ended(e):
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b"), F.col("b")).distinct())


def hashed_share(df: DataFrame, col: str, n: int, want: int):
    """Rows of some ``want`` hashed ids of ``n``, twice as many in the mean, so that no task offers more to a limit."""
    unit = F.shiftrightunsigned(F.xxhash64(F.col(col), F.lit(21)), 11) / float(2**53)
    return df if n <= 2 * want else df.where(unit < 2 * want / n)
