"""Removal of repeated lines, also with one edit, by a deletion-neighbourhood join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mix, read, release, stored, text_or_empty

MIN_CHARS = 16
SALTS = 8
BROADCAST_ROWS = 100_000
BASE = np.uint64(0x9E3779B97F4A7C15)


def deletion_hashes(line: str) -> tuple[np.uint64, np.ndarray]:
    """Hashes of a line and of the line without its i-th code point for each i, in time linear in its length."""
    x = mix(np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))
    n = len(x)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.append(np.uint64(1), np.full(n, BASE)), dtype=np.uint64)
        terms = x * powers[:n]
        upto = np.append(np.uint64(0), np.cumsum(terms, dtype=np.uint64))
        # what stands right of a deleted place moves one to the left, that is: has been multiplied once too often
        inverse = np.uint64(pow(int(BASE), -1, 2**64))
        without = upto[:n] + (upto[n] - upto[1:]) * inverse
    return mix(upto[n : n + 1] ^ np.uint64(n))[0], mix(without ^ np.uint64(n - 1))


def lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """(spot, line, id) for each line of at least ``min_chars`` code points; spots (last, doc_id, row, no) are ordered."""
    text = text_or_empty()
    rows = docs.select(F.col("doc_id").isNull().alias("last"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text).alias("row"), F.posexplode(F.split(text, "\n", -1)).alias("no", "line"))
    rows = rows.where(F.char_length("line") >= min_chars)
    return rows.select(F.struct("last", "doc_id", "row", "no").alias("spot"), "line", F.unhex(F.md5(F.col("line").cast("binary"))).alias("id"))


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


SPOT = "struct<last:boolean,doc_id:bigint,row:bigint,no:int>"


def near_lines(lines: DataFrame, distinct: DataFrame) -> DataFrame:
    """(id): the distinct lines for which some line within one edit stands earlier.

    1. Two lines within one edit agree in their first or in their last half (of the shorter one's length n: n // 2 code
       points). Lines that agree so with no other line have no neighbour and are left out; for the rest only deletions
       in the other half can lead to one.
    2. The rest emit the hash of each such deletion with its place, and of the line itself with place -1.
    3. Equal hashes meet. Equal places are one substitution; a line and a deletion of another are one insertion. A
       group of the same hash and place holds at most as many lines as there are characters.
    4. Edit distances of the pairs are verified on the texts.
    """
    halves = distinct.select("id", "first", F.explode("halves").alias("half"))
    both = halves.groupBy("half.key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a != b")
    both = both.select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = halves.select("id", "first", "half.*").withColumn("salt", F.pmod(F.hash("id"), F.lit(SALTS)))
    met = salted.join(both, ["key", "salt"], "left_semi")
    # places from `low` on and places before `high` can hold the edit
    alive = stored(met.groupBy("id", "first").agg(F.coalesce(F.min(F.when(F.col("head"), F.col("cut"))), F.lit(2**31 - 1)).alias("low"), F.coalesce(F.max(F.when(~F.col("head"), F.col("cut"))), F.lit(0)).alias("high")), "lines-alive")
    n_alive = alive.count()
    # the text of a line is taken where it stands first
    firsts = alive.select(F.col("first.row").alias("row"), F.col("first.no").alias("no"), "id", "low", "high")
    texts = lines.select("spot", F.col("spot.row").alias("row"), F.col("spot.no").alias("no"), "line", "id").join(small(firsts, n_alive), ["row", "no", "id"])
    texts = stored(texts.drop("row", "no").distinct(), "lines-alive-text")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                keys, places = [], []
                for line, low, high in zip(*(b.column(c).to_pylist() for c in ("line", "low", "high")), strict=True):
                    own, without = deletion_hashes(line)
                    place = np.arange(len(without))
                    place = place[(place >= low) | (place < high)]
                    keys.append(np.append(own, without[place]))
                    places.append(np.append(-1, place).astype(np.int32))
                row = pa.array(np.repeat(np.arange(b.num_rows), [len(k) for k in keys]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(places)), b.column("spot").take(row)], names=["key", "place", "own"])

    variants = texts.select("spot", "line", "low", "high").mapInArrow(emit, f"key long, place int, own {SPOT}")
    same = Window.partitionBy("key", "place")
    hash_ = Window.partitionBy("key")
    deeper = F.min(F.when(F.col("place") < 0, F.col("own"))).over(hash_)
    anyone = F.min("own").over(hash_)
    variants = variants.repartition("key").select("key", "place", "own", F.min("own").over(same).alias("a"), deeper.alias("b"), F.when(F.col("place") < 0, anyone).alias("c"))
    pairs = variants.select("own", F.explode(F.array("a", "b", "c")).alias("early")).where("early < own").distinct()
    # spots are joined by row and number, since a field of theirs can be null
    pairs = pairs.select("own.row", "own.no", F.col("early.row").alias("early_row"), F.col("early.no").alias("early_no"))
    left = texts.select("spot.row", "spot.no", "line", "id")
    right = texts.select(F.col("spot.row").alias("early_row"), F.col("spot.no").alias("early_no"), F.col("line").alias("early_line"))
    checked = pairs.join(left, ["row", "no"]).join(right, ["early_row", "early_no"]).where(F.levenshtein("line", "early_line", 1) >= 0)
    near = stored(checked.select("id").distinct(), "lines-near")
    release(alive, texts)
    return near


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) for each row, and its columns ``keep``: without lines that repeat an earlier line within one edit.

    Lines end at \\n and are ordered by doc_id, a hash of id and text, and line number; rows without an id come last. A
    line of at least ``min_chars`` code points goes if an equal line stands earlier, or if its text's first occurrence has
    a line within edit distance 1 earlier still; shorter lines always stay. Null texts stay null and have no lines; an
    empty text has one empty line. Rows that repeat both id and text keep the same lines; rows that repeat only the id are
    judged each. An empty table gives an empty result; texts are never cut, and other columns are not read.
    """
    lines = lines_of(docs, min_chars)
    n = F.char_length("line")
    half = lambda head, h: F.struct(
        F.when(F.lit(head), F.xxhash64(F.lit(1), h, F.col("line").substr(F.lit(1), h))).otherwise(F.xxhash64(F.lit(2), h, F.col("line").substr(n - h + 1, h))).alias("key"),
        F.lit(head).alias("head"), (h if head else n - h).alias("cut"),
    )
    cuts = [F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")]
    halves = F.array_distinct(F.array(*[half(head, h) for head in (True, False) for h in cuts]))
    seen = lines.select("id", "spot", halves.alias("halves")).groupBy("id").agg(F.min("spot").alias("first"), F.first("halves").alias("halves"), F.count(F.lit(1)).alias("n"))
    distinct = stored(seen, "lines")
    near = near_lines(lines, distinct)
    gone = distinct.select("id", "first", "n").join(near.withColumn("near", F.lit(True)), "id", "left").where("n > 1 OR near")
    # a line can have very many occurrences: they are dealt over SALTS keys
    gone = gone.select("id", F.col("first.row").alias("first_row"), F.col("first.no").alias("first_no"), "near", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    spots = lines.select("id", "spot.row", "spot.no", F.pmod("spot.row", F.lit(SALTS)).cast("int").alias("salt")).join(gone, ["id", "salt"])
    spots = spots.where(F.coalesce("near", F.lit(False)) | (F.col("row") != F.col("first_row")) | (F.col("no") != F.col("first_no")))
    drops = stored(spots.groupBy("row").agg(F.collect_set("no").alias("drops")), "line-drops")
    release(distinct, near)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64("doc_id", F.coalesce(text, F.lit(""))).alias("row"), *keep)
    parts = F.split("text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "drops")
    # within a transform over one element, the text is split once and not for each line
    joined = F.transform(F.array(parts), lambda p: F.array_join(F.transform(left, lambda i: F.get(p, i)), "\n"))
    kept = F.when(F.col("drops").isNull(), F.col("text")).otherwise(joined[0])
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(parts))
    return rows.join(drops, "row", "left").select("doc_id", kept.alias("text"), n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"), *keep)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(read(spark, sf_dir, "documents"))


#: Quadratic in the lines of a length; for the small tables only.
ORACLE = """
WITH l AS (SELECT doc_id, no, parts[no] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS no
           FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))),
     big AS (SELECT * FROM l WHERE length(line) >= 16),
     d AS (SELECT line, min((doc_id, no)) AS first, length(line) AS n FROM big GROUP BY line),
     near AS (SELECT DISTINCT a.line FROM d a JOIN d b ON b.n BETWEEN a.n - 1 AND a.n + 1 AND b.first < a.first
              AND (left(a.line, (least(a.n, b.n) // 2)::INT) = left(b.line, (least(a.n, b.n) // 2)::INT) OR right(a.line, (least(a.n, b.n) // 2)::INT) = right(b.line, (least(a.n, b.n) // 2)::INT))
              AND levenshtein(a.line, b.line) <= 1),
     k AS (SELECT l.doc_id, l.no, l.line, length(l.line) >= 16 AND ((l.doc_id, l.no) <> d.first OR near.line IS NOT NULL) AS gone
           FROM l LEFT JOIN d ON l.line = d.line LEFT JOIN near ON l.line = near.line)
SELECT documents.doc_id, CASE WHEN documents.text IS NULL THEN NULL ELSE coalesce(x.text, '') END AS text,
       CAST(coalesce(x.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(x.n_dropped, 0) AS BIGINT) AS n_dropped
FROM documents LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT coalesce(gone, false)) AS text,
                                 count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped FROM k GROUP BY doc_id) x
ON documents.doc_id = x.doc_id
"""
