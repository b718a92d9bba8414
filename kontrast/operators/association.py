"""Association over ranks and pairs: rank information, correlations, conditional information, histograms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .counting import windows

LN2 = math.log(2)


def confusion(rows: DataFrame, value: str = "x") -> DataFrame:
    """(contrast, tp, fp, fn, tn) from presence (or its probability) by set: set 0 is the signal."""
    signal = F.col("set_id") == 0
    x = F.col(value).cast("double")
    s = lambda c: F.sum(c)
    return rows.groupBy("contrast").agg(
        s(F.when(signal, x).otherwise(0.0)).alias("tp"), s(F.when(~signal, x).otherwise(0.0)).alias("fp"), s(F.when(signal, 1 - x).otherwise(0.0)).alias("fn"), s(F.when(~signal, 1 - x).otherwise(0.0)).alias("tn")
    )


def prefix_sums(rows: DataFrame, by: list[str], rank: str, value: str, block: int = 4096) -> DataFrame:
    """Adds ``upto`` and ``place``: sum of values and number of rows to this row in rank order, and the group's totals.

    A group isn't ordered in one task: rows are summed within blocks of ranks, blocks (few) are summed in order, and
    both are added. Ranks are taken as integers; ties are ordered by nothing else and share no row.
    """
    rows = rows.withColumn("__block", F.floor(F.col(rank) / block))
    blocks = rows.groupBy(*by, "__block").agg(F.sum(value).alias("__v"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    blocks = blocks.select(*by, "__block", F.coalesce(F.sum("__v").over(before), F.lit(0.0)).alias("__v0"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"), F.sum("__v").over(whole).alias("total"), F.sum("__n").over(whole).alias("n"))
    inside = Window.partitionBy(*by, "__block").orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__v1", F.sum(value).over(inside)).withColumn("__n1", F.count(F.lit(1)).over(inside))
    return rows.join(blocks, [*by, "__block"]).withColumns({"upto": F.col("__v0") + F.col("__v1"), "place": F.col("__n0") + F.col("__n1")}).drop("__block", "__v0", "__n0", "__v1", "__n1")


def information_2x2(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Bits of a table with rows (a, b) and (c, d); empty cells add nothing."""
    z = a + b + c + d
    cell = lambda x, r, k: F.when(x > 0, x / z * F.log(x * z / (r * k))).otherwise(F.lit(0.0))
    return (cell(a, a + b, a + c) + cell(b, a + b, b + d) + cell(c, c + d, a + c) + cell(d, c + d, b + d)) / LN2


def rank_information(rows: DataFrame, by: list[str], rank: str = "rank", value: str = "x", ps: float = 1.0) -> DataFrame:
    """Mean, over the cuts of the ranked rows, of the information between being before the cut and presence.

    n - 1 cuts are summed and divided by n.
    """
    r = prefix_sums(rows.withColumn(value, F.col(value).cast("double")), by, rank, value)
    p = F.lit(float(ps))
    before, after = F.col("place").cast("double"), (F.col("n") - F.col("place")).cast("double")
    mi = information_2x2(F.col("upto") + p, before - F.col("upto") + p, F.col("total") - F.col("upto") + p, after - (F.col("total") - F.col("upto")) + p)
    return r.groupBy(*by).agg((F.sum(F.when(F.col("place") < F.col("n"), mi).otherwise(0.0)) / F.max("n")).alias("rank_information"))


def moving_average(rows: DataFrame, by: list[str], rank: str, value: str, width: int) -> DataFrame:
    """Mean of a value over each row and the ``width`` - 1 before it in rank order."""
    w = Window.partitionBy(*by).orderBy(rank).rowsBetween(-(width - 1), 0)
    return rows.withColumn("moving", F.avg(value).over(w))


def tied_ranks(rows: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Average rank among equal values, counted from the distinct values, so ties meet before they are ranked."""
    n = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumn(out, F.coalesce(F.sum("__n").over(w), F.lit(0)) + (F.col("__n") + 1) / 2.0)
    return rows.join(n.select(*by, value, out), [*by, value])


def correlations(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(n, pearson, spearman, fisher_z, t) of two values within groups."""
    r = tied_ranks(tied_ranks(rows, by, x, "__rx"), by, y, "__ry")
    out = r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("pearson"), F.corr("__rx", "__ry").alias("spearman"))
    s = F.col("pearson")
    return out.withColumns({"fisher_z": 0.5 * F.log((1 + s) / (1 - s)), "t": s * F.sqrt((F.col("n") - 2) / (1 - s * s))})


def pair_information(rows: DataFrame, by: list[str], a: str, b: str, ps: float = 1.0) -> DataFrame:
    """Information between the presences (or independent probabilities) of two patterns."""
    x, y, p = F.col(a).cast("double"), F.col(b).cast("double"), F.lit(float(ps))
    s = rows.groupBy(*by).agg(F.sum(x * y).alias("__11"), F.sum(x * (1 - y)).alias("__10"), F.sum((1 - x) * y).alias("__01"), F.sum((1 - x) * (1 - y)).alias("__00"))
    return s.select(*by, information_2x2(F.col("__11") + p, F.col("__10") + p, F.col("__01") + p, F.col("__00") + p).alias("pair_information"))


def conditional_information(rows: DataFrame, contrast: str, a: str, b: str, ps: float = 1.0) -> DataFrame:
    """I(a; set | b): what a pattern tells of the set once another one is known, from sums over each set."""
    x, y, p = F.col(a).cast("double"), F.col(b).cast("double"), float(ps)
    cells = rows.groupBy(contrast, "set_id").agg(F.sum(x * y).alias("s11"), F.sum((1 - x) * y).alias("s01"), F.sum(x * (1 - y)).alias("s10"), F.sum((1 - x) * (1 - y)).alias("s00"))
    long = cells.select(contrast, "set_id", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), (F.col(f"s{i}{k}") + p).alias("n")) for i in (0, 1) for k in (0, 1)])).alias("c")).select(contrast, "set_id", "c.*")
    w = lambda *c: F.sum("n").over(Window.partitionBy(contrast, *c))
    t = F.col("n") / w() * F.log(F.col("n") * w("k") / (w("i", "k") * w("set_id", "k")))
    long = long.withColumn("t", F.when(F.col("n") > 0, t).otherwise(0.0))
    return long.groupBy(contrast).agg((F.sum("t") / LN2).alias("conditional_information"))


def center_histogram(occurrences: DataFrame, width: int = 10) -> DataFrame:
    """Occurrences by their distance from the centre of the sequence, in bins."""
    return occurrences.groupBy("contrast", "set_id", "motifname", (F.floor(F.col("centerdist") / width) * width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def pwm_scan(seqs: DataFrame, pwm: list[list[float]]) -> DataFrame:
    """(contrast, set_id, seq_id, pos, p): product of emissions in each window; a base that isn't acgt gives 0."""
    rows = seqs.select("contrast", "set_id", "seq_id", F.posexplode(windows(F.col("sequence"), len(pwm))).alias("pos", "word"))
    p = F.lit(1.0)
    for i, probs in enumerate(pwm):
        letter = F.substring("word", i + 1, 1)
        p = p * F.when(letter == "a", probs[0]).when(letter == "c", probs[1]).when(letter == "g", probs[2]).when(letter == "t", probs[3]).otherwise(0.0)
    return rows.select("contrast", "set_id", "seq_id", "pos", p.alias("p"))


def logo_heights(rows: DataFrame) -> DataFrame:
    """(pos, base, p, height, place) of a matrix (pos, a, c, g, t): heights p * information / 2, the tallest last on top."""
    ic = F.lit(2.0)
    for b in "acgt":
        ic = ic + F.when(F.col(b) > 0, F.col(b) * F.log2(F.col(b))).otherwise(0.0)
    long = rows.select("pos", ic.alias("ic"), F.explode(F.array(*[F.struct(F.lit(b).alias("base"), F.col(b).alias("p")) for b in "acgt"])).alias("x")).select("pos", "ic", "x.*")
    place = F.row_number().over(Window.partitionBy("pos").orderBy("p", "base"))
    return long.select("pos", "base", "p", (F.col("p") * F.col("ic") / 2).alias("height"), place.alias("place"))
