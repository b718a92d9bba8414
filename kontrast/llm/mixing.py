"""Mixing sources to target weights by entropy balancing; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, stored, text_or_empty

MOST = 2.0
BUCKET = 2048


def word_count(col: str = "text") -> Column:
    """Number of maximal runs of characters other than blank and \\t to \\r."""
    return F.regexp_count(text_or_empty(col), F.lit(r"[^\x20\x09-\x0D]++")).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...], share: float, most: float = MOST) -> DataFrame:
    """(source, n_docs, source_size, target) for each source.

    Sources in code-point order, null last, take the weights in turn and share ``share`` times all sizes; a target
    stops at ``most`` times its source's size and the excess is shared again by weight until none is above. Each round
    fixes at least one source, and only one row for each source is touched.
    """
    sums = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    sums = stored(sums.withColumn("weight", weight).withColumn("cap", most * F.col("source_size").cast("double")), "sources")
    total = sums.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    open_ = F.lit(True)
    while True:  # level: words for a unit of weight among sources that haven't reached their cap
        r = sums.agg(F.sum(F.when(open_, F.col("weight"))).alias("w"), F.sum(F.when(~open_, F.col("cap"))).alias("capped")).first()
        if not r["w"]:
            break
        new = (share * total - (r["capped"] or 0.0)) / r["w"]
        if new <= level * (1 + 1e-15):
            break
        level = new
        open_ = F.col("cap") > level * F.col("weight")
    return sums.select("source", "n_docs", "source_size", F.least(F.col("cap"), level * F.col("weight")).alias("target"))


def tilts(sized: DataFrame, targets: DataFrame, most: float = MOST, rounds: int = 60) -> DataFrame:
    """(source, unit, tilt): rates ``most`` / (1 + exp(-tilt * size / unit)) whose words sum to each target.

    Of all rates between 0 and ``most`` that meet a source's token constraint these are the nearest in entropy to a rate
    of ``most`` / 2: minimising the dual, the sum of ``most`` * log(1 + exp(tilt * size)) less tilt * target, gives this
    exponential tilt. The dual has one variable a source. Each Newton step sums its gradient and curvature over a table
    of (source, size, documents), and is kept within a bracket around the root.
    """
    sizes = stored(sized.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    state = targets.select("source", "target", "source_size", F.greatest(F.lit(1.0), F.col("source_size") / F.col("n_docs")).alias("unit"))
    state = state.withColumns({"tilt": F.lit(0.0), "lo": F.lit(-60.0), "hi": F.lit(60.0), "done": F.col("target") >= most * F.col("source_size")})
    state = stored(state.withColumn("tilt", F.when(F.col("done"), 700.0).otherwise(0.0)), "tilts")
    for _ in range(rounds):
        x = F.col("size") / F.col("unit")
        p = 1 / (1 + F.exp(-F.col("tilt") * x))
        sums = (
            sizes.alias("z").join(state.where("NOT done").alias("s"), F.col("z.source").eqNullSafe(F.col("s.source")))
            .groupBy("s.source").agg(F.sum(F.col("n") * F.col("size") * most * p).alias("got"), F.sum(F.col("n") * F.col("size") * x * most * p * (1 - p)).alias("slope"))
            .withColumnRenamed("source", "k")
        )
        gap = F.col("target") - F.col("got")
        lo, hi = F.when(gap > 0, F.col("tilt")).otherwise(F.col("lo")), F.when(gap <= 0, F.col("tilt")).otherwise(F.col("hi"))
        step = F.col("tilt") + gap / F.col("slope")
        inside = (F.col("slope") > 0) & (step > lo) & (step < hi)
        moved = F.when(inside, step).when(gap > 0, F.least(hi - (hi - F.col("tilt")) / 2, F.col("tilt") + 4)).otherwise(F.greatest(lo + (F.col("tilt") - lo) / 2, F.col("tilt") - 4))
        end = F.col("done") | F.col("got").isNull() | (F.abs(gap) <= 1e-7 * F.col("target") + 1e-9)
        both = state.join(sums, F.col("source").eqNullSafe(F.col("k")), "left")
        state = stored(
            both.select("source", "target", "source_size", "unit", F.when(end, F.col("tilt")).otherwise(moved).alias("tilt"), F.coalesce(lo, "lo").alias("lo"), F.coalesce(hi, "hi").alias("hi"), end.alias("done")),
            "tilts",
        )
        if state.where("NOT done").isEmpty():
            break
    return state.select("source", "unit", "tilt")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of ``docs``, with the columns named in ``keep``.

    ``taken`` is size times a whole number of copies from 0 to ``most``, so no document exceeds ``most`` times its size.
    A document's rate comes from ``tilts``. Rates become copies by systematic rounding along the sizes within parts of a
    source of some 2048 documents each: the running sum of copies never is further than half a copy from that of rates, so a part's words
    miss by less than its largest document. The order is by size and hashed id: reruns agree. A null or empty text
    has size 0 and is never taken; a null source is a source of its own, the last one. Repeated ids are separate rows.
    """
    text_free = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"), *keep)
    sized = stored(text_free, "sized")
    targets = stored(source_targets(sized, weights, share, float(most)), "targets")
    info = stored(
        targets.alias("t").join(tilts(sized, targets, float(most)).alias("u"), F.col("t.source").eqNullSafe(F.col("u.source")))
        .select(F.col("t.source").alias("src"), "n_docs", "source_size", "target", "unit", "tilt"),
        "rates",
    )
    rated = sized.join(info, F.col("source").eqNullSafe(F.col("src")))
    rate = F.when(F.col("size") > 0, most / (1 + F.exp(-F.col("tilt") * F.col("size") / F.col("unit")))).otherwise(0.0)
    parts = F.greatest(F.lit(1), (F.col("n_docs") / BUCKET).cast("long"))
    order = F.xxhash64("doc_id", F.lit(5))
    rated = rated.withColumns({"rate": rate, "part": F.pmod(order, parts), "order": order})
    w = Window.partitionBy("source", "part").orderBy(F.desc("size"), "order", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("rate").over(w)
    copies = F.floor(F.round(upto, 9) + 0.5) - F.floor(F.round(upto - F.col("rate"), 9) + 0.5)
    copies = F.least(F.lit(most), F.greatest(F.lit(0), copies))
    return rated.withColumn("copies", copies).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), *keep)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))
