"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_words, hashed_share, mix, read, stored, text_or_empty

BITS = 20
BLOCK = 1 << 14
LABELLED = 50_000
#: Standard errors between a class and all text at which a feature's log ratio counts by half, and the part of the error of
#: a log count that more texts don't lessen: words come in copies, in bursts and by language.
EVIDENCE, BURST = 3.0, 0.7
SMOOTHING = 2e3
TEMPERATURE = 0.5
#: Tasks, or sums of tasks, that are added up at a time.
FAN = 64
#: Classes of labelled rows: accepted (the target), low quality, toxic.
CLASSES = 3

_letters, _digits, _runs = re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"(.)\1+")


def shape(word: str) -> str:
    """A word with letters, digits and repeated characters folded: ``THE!!!`` to ``X!!``, ``a1.50`` to ``x9.9``."""
    word = _letters.sub(lambda m: "X" if len(m[0]) > 1 and m[0].isupper() else "x", word)
    return _runs.sub(r"\1\1", _digits.sub("9", word))


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the distinct hashed features of each text: words, and one- and two-grams of word shapes.

    Shapes are marked where a word repeats the one before it.
    """
    words: list[str] = []
    ends = np.zeros(len(texts) + 1, np.int64)
    for i, t in enumerate(texts):
        if t:
            words += t.split()
        ends[i + 1] = len(words)
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    coded = pa.array([w.encode("utf-8", "replace") for w in words], pa.large_binary()).dictionary_encode()
    distinct, at = [w.decode() for w in coded.dictionary.to_pylist()], coded.indices.to_numpy()
    word = hash_words([w.lower().strip(".,").encode() for w in distinct])[at]
    form = hash_words([shape(w).encode() for w in distinct])[at]
    text = np.repeat(np.arange(len(texts)), np.diff(ends))
    same = text[1:] == text[:-1]
    with np.errstate(over="ignore"):
        form[1:] += np.uint64(999) * ((word[1:] == word[:-1]) & same)
        pairs = mix(form[:-1] * np.uint64(37) + form[1:] + np.uint64(11))[same]
        bucket = np.concatenate([mix(word), mix(form + np.uint64(5)), pairs]) & np.uint64((1 << BITS) - 1)
    key = np.unique((np.concatenate([text, text, text[1:][same]]) << BITS) | bucket.astype(np.int64))
    return key >> BITS, key & ((1 << BITS) - 1)


def class_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, 2).when(quality == 0, 1).when(quality == 1, 0)


class Model:
    """Log ratios of each class's n-gram model to that of all text, and the classes' shares."""

    def __init__(self, everything: np.ndarray, by_class: np.ndarray, n_docs: np.ndarray):
        base = (everything + 0.5) / (everything.sum() + 0.5 * len(everything))
        ratios = []
        for counts in by_class:
            expected = counts.sum() * base
            error = np.sqrt(1 / (counts + 0.5) + 1 / (expected + 0.5) + BURST**2)
            clear = (np.abs(np.log(counts + 0.5) - np.log(expected + 0.5)) / error) ** 4
            r = np.log((counts + SMOOTHING * base) / (counts.sum() + SMOOTHING)) - np.log(base)
            ratios.append(r * clear / (clear + EVIDENCE**4))
        self.ratios = np.array(ratios, np.float32)
        self.prior = np.log((n_docs + 1) / (n_docs.sum() + len(n_docs)))

    def log_share(self, texts: list[str | None]) -> np.ndarray:
        """Log of the target's part in the raw model at each text: its importance weight less log of 1 / target's share."""
        text, bucket = features(texts)
        s = np.stack([np.bincount(text, r[bucket], len(texts)) for r in self.ratios], 1) + self.prior
        top = s.max(1)
        return s[:, 0] - top - np.log(np.exp(s - top[:, None]).sum(1))


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model:
    """Counts, over all of ``docs``, the texts that have each feature, and the same for labelled texts of each class.

    The labelled rows are at most ``labelled``, of a share of hashed ids. A document labelled more than once counts
    as toxic if any label says so, else as low if any does; labels that are null in either column are left out.
    """
    kinds = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("label_id"))
    kinds = kinds.agg(F.max(class_of(F.col("quality"), F.col("toxic"))).alias("kind")).where("kind IS NOT NULL")
    kinds = stored(kinds, "labelled")
    kinds = hashed_share(kinds, "label_id", kinds.count(), labelled).orderBy(F.xxhash64("label_id"), "label_id").limit(labelled)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(kinds), F.col("doc_id") == F.col("label_id"), "left").select("text", "kind")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros((CLASSES + 1, 1 << BITS), np.int64), np.zeros(CLASSES + 1, np.int64)
        for b in batches:
            kind = b.column("kind").fill_null(-1).to_numpy(zero_copy_only=False)
            text, bucket = features(b.column("text").to_pylist())
            for c in range(-1, CLASSES):
                hit = bucket if c < 0 else bucket[kind[text] == c]
                counts[c] += np.bincount(hit, minlength=1 << BITS)
                n[c] += len(kind) if c < 0 else (kind == c).sum()
        cells = [(c, k, int(n[c]) if not k else 0, counts[c, k * BLOCK : (k + 1) * BLOCK].astype("<i4").tobytes()) for c in range(CLASSES + 1) if n[c] for k in range((1 << BITS) // BLOCK)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*cells, strict=True) if cells else [[]] * 4, [pa.int32(), pa.int32(), pa.int64(), pa.binary()], strict=True)], names=["kind", "block", "n", "counts"])

    def add(g: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK, np.int64)
        for blob in g["counts"]:
            total += np.frombuffer(blob, "<i4" if len(blob) == 4 * BLOCK else "<i8")
        return pd.DataFrame({"kind": [g["kind"].iloc[0]], "block": [g["block"].iloc[0]], "n": [g["n"].sum()], "counts": [total.astype("<i8").tobytes()], "part": [g["part"].iloc[0]]})

    cells = "kind int, block int, n long, counts binary"
    # FAN tasks' counts are added up at a time, then FAN of these sums, so no task gathers those of all
    sums = rows.mapInArrow(count, cells).withColumn("part", F.spark_partition_id())
    for _ in range(2):
        sums = sums.withColumn("part", (F.col("part") / FAN).cast("int")).groupBy("kind", "block", "part").applyInPandas(add, f"{cells}, part int")
    sums = sums.groupBy("kind", "block").applyInPandas(add, f"{cells}, part int")
    found, n = np.zeros((CLASSES + 1, 1 << BITS)), np.zeros(CLASSES + 1)
    for r in sums.collect():  # (CLASSES + 1) * 2**BITS counts, whatever the input
        found[r["kind"], r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["counts"], "<i8")
        n[r["kind"]] += r["n"]
    return Model(found[CLASSES], found[:CLASSES], n[:CLASSES])


def kth_largest(df: DataFrame, col: str, k: int) -> float:
    """The k-th largest value of a column: its range is cut into 1024 bins until one bin holds few values."""
    lo, hi = df.agg(F.min(col), F.max(col)).first()
    while True:
        width = (hi - lo) / 1024
        if width <= 0 or lo + width == lo:
            return lo
        inside = df.where(F.col(col).between(lo, hi))
        place = F.least(F.lit(1023), F.floor((F.col(col) - lo) / width))
        bins = sorted(inside.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).collect(), reverse=True)
        for b in bins:
            if k <= b["n"]:
                break
            k -= b["n"]
        lo, hi = b["lo"], b["hi"]
        if b["n"] <= 10_000:
            return sorted((r[0] for r in df.where(F.col(col).between(lo, hi)).select(col).collect()), reverse=True)[k - 1]


def classify(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, temperature: float = TEMPERATURE, k: int | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(log_weight, key, kept) for each row of ``docs``, after its columns ``keep``.

    The target's model is that of accepted labelled text. The model of raw text is a mixture, of accepted, low and toxic
    text in their labelled shares: raw documents are of one kind or another, so a single model of n-grams drawn one by one
    would spread the junk of a few over all, and its weights would mostly tell the length of a text. Each model is smoothed
    by the counts over all documents; the log ratio of a feature shrinks towards 0 where its class differs from all text by
    few standard errors. The importance weight of a text is target over raw, at most 1 / the target's share. ``key`` is
    its log plus Gumbel noise of the given temperature, drawn from a hash of the id and text: at temperature 1 the ``k``
    largest keys are a sample without replacement by weight. ``k`` is the number of texts that are rather target than not
    unless given. Ties at the edge stay. A null or empty text has no features: its weight is 1. Rows that repeat id and text
    get the same result. Without usable labels every text has weight 1 and stays.
    """
    model = fit(docs, labels, labelled)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def log_share(text: pd.Series) -> pd.Series:
        return pd.Series(shared.value.log_share(text.to_list()))

    unit = (F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), text_or_empty(), F.lit(8)), 11) + 0.5) / float(2**53)
    rows = docs.select(*keep, log_share(text_or_empty()).alias("__share"), (-F.log(-F.log(unit)) * temperature).alias("__noise"))
    rows = rows.withColumn("log_weight", F.col("__share") - float(model.prior[0])).withColumn("key", F.col("log_weight") + F.col("__noise"))
    scored = stored(rows.drop("__noise"), "scored")
    if k is None:
        k = scored.where(F.col("__share") >= min(math.log(0.5), float(model.prior[0]))).count()
    edge = kth_largest(scored, "key", k) if k else math.inf
    return scored.select(*keep, "log_weight", "key", (F.col("key") >= edge).alias("kept"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
