"""Search for the patterns whose presence best separates sets: a beam that generalises step by step."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions.alphabet import degeneracy, generalizations, reverse_complement
from .counting import motif_counts, pattern_hits, set_sizes, word_counts
from .masking import mask_motif, remove_motif


@dataclass
class Objective:
    """What to optimise: a measure, over signed contrasts (all with sign +1 if none is named)."""

    measure: str = "mi"
    contrasts: dict[str, int] = field(default_factory=dict)
    weighted: bool = False
    motif: str = ""
    #: Numbers of the sets that are the signal of a contrast; its first set where none is named.
    signals: dict[str, list[int]] = field(default_factory=dict)


@dataclass
class Options:
    candidates: int = 100
    pseudo_count: float = 1.0
    max_degeneracy: int | None = None
    relative_degeneracy: float = 1.0
    both_strands: bool = False
    per_occurrence: bool = False
    enriched_only: bool = True
    strict: bool = False
    fixed_correction: bool = False
    mode: str = "mask"


@dataclass
class Found:
    motif: str
    score: float
    log_p: float
    counts: dict[tuple[str, int], int]


def sizes_of(seqs: DataFrame, per_occurrence: bool = False, k: int = 1) -> dict[str, list[tuple[int, int]]]:
    """Sets and what counts are out of, by contrast; a few rows whatever the input."""
    out: dict[str, list[tuple[int, int]]] = {}
    for r in set_sizes(seqs).orderBy("contrast", "set_id").collect():
        out.setdefault(r["contrast"], []).append((r["set_id"], max(0, r["seq_size"] - r["set_size"] * (k - 1)) if per_occurrence else r["set_size"]))
    return out


def ordered(sizes: dict[str, list[tuple[int, int]]], signals: dict[str, list[int]] | None) -> dict[str, list[tuple[int, int]]]:
    """``sizes`` with the signal's sets of each contrast first."""
    return {c: sorted(sets, key=lambda x: (x[0] not in signals[c], x[0])) if signals and c in signals else sets for c, sets in sizes.items()}


def wide_counts(counts: DataFrame, sizes: dict[str, list[tuple[int, int]]], key: str) -> DataFrame:
    """One row for each pattern with a column for each set, 0 where it never stands."""
    cols = [F.coalesce(F.sum(F.when((F.col("contrast") == c) & (F.col("set_id") == s), F.col("n"))), F.lit(0)).alias(f"{c}:{s}") for c, sets in sizes.items() for s, _ in sets]
    return counts.groupBy(key).agg(*cols)


def score_column(sizes: dict[str, list[tuple[int, int]]], objective: Objective, ps: float, enriched_only: bool) -> Column:
    """The objective over the columns of ``wide_counts``. A contrast that isn't there is an error."""
    signs = objective.contrasts or {c: 1 for c in sizes}
    if missing := set(signs) - set(sizes):
        raise ValueError(f"no such contrast: {', '.join(sorted(missing))}")
    parts = []
    sizes = ordered(sizes, objective.signals)
    for c, sign in signs.items():
        cells = [(F.least(F.col(f"`{c}:{s}`"), F.lit(n)), F.lit(n)) for s, n in sizes[c]]
        parts.append((sign, M.measure(objective.measure, cells, ps, enriched_only), F.lit(float(sum(n for _, n in sizes[c]))) if objective.weighted else None))
    return M.combined(parts)


def top(df: DataFrame, n: int, key: str) -> DataFrame:
    return df.orderBy(F.desc("score"), key).limit(n)


def find_seeds(seqs: DataFrame, length: int, objective: Objective, opt: Options) -> DataFrame:
    """(motif, degeneracy, score, counts by set) of the beam, best first.

    Level 0 counts pure words; each further level adds one base at one place to the beam's patterns, keeps those that
    score at least as much as their best parent, and cuts to the beam's width (ties by the pattern). The beam is a report
    of fixed size; counting covers all sequences at every level, in one pass.
    """
    sizes = sizes_of(seqs, opt.per_occurrence, length)
    score = score_column(sizes, objective, opt.pseudo_count, opt.enriched_only)
    counts = word_counts(seqs, length, opt.both_strands, opt.per_occurrence).withColumnRenamed("word", "motif")
    scored = wide_counts(counts, sizes, "motif").withColumn("score", score).where(F.col("score") > -math.inf)
    spark = seqs.sparkSession

    def local(df: DataFrame) -> DataFrame:
        """A beam is small: it is brought to the driver and back, which ends the plan that made it."""
        return spark.createDataFrame(df.collect(), df.schema)

    beam = local(top(scored, opt.candidates, "motif"))
    best = beam
    most = min(3 * length if opt.max_degeneracy is None else opt.max_degeneracy, int(3 * length * opt.relative_degeneracy))
    for _ in range(most):
        if beam.isEmpty():
            break
        child = F.least(F.col("child"), reverse_complement(F.col("child"))) if opt.both_strands else F.col("child")
        kids = generalizations(beam.select("motif", "score"), "motif").withColumn("child", child).groupBy("child").agg(F.max("score").alias("parent_score"))
        hits = strand_hits(seqs, kids.select(F.col("child").alias("pattern")), length, opt)
        again = wide_counts(hits, sizes, "motif").withColumn("score", score)
        again = again.join(F.broadcast(kids), F.col("motif") == F.col("child")).where("score >= parent_score").drop("child", "parent_score")
        beam = local(top(again.where(F.col("score") > -math.inf), opt.candidates, "motif"))
        best = best.unionByName(beam)
    out = local(best.dropDuplicates(["motif"]).withColumn("degeneracy", degeneracy(F.col("motif"))).orderBy(F.desc("score"), "motif"))
    return out


def strand_hits(seqs: DataFrame, patterns: DataFrame, length: int, opt: Options) -> DataFrame:
    """(motif, contrast, set_id, n). With both strands the words are canonical, so a pattern also matches by its twin."""
    n = "word_hits" if opt.per_occurrence else "seq_hits"
    forms = F.array("pattern", reverse_complement(F.col("pattern"))) if opt.both_strands else F.array("pattern")
    hits = pattern_hits(seqs, patterns.select("pattern", F.explode(forms).alias("form")), length, opt.both_strands, opt.per_occurrence)
    return hits.select(F.col("pattern").alias("motif"), "contrast", "set_id", F.col(n).alias("n"))


def _found(row, sizes, objective: Objective, opt: Options) -> Found:
    import numpy as np

    log_p = 0.0
    for c in objective.contrasts or sizes:
        k = [(row[f"{c}:{s}"] + opt.pseudo_count, n + 2 * opt.pseudo_count) for s, n in sizes[c]]
        z, present = sum(n for _, n in k), sum(a for a, _ in k)
        g = 2 * sum(x * math.log(x * z / (n * col)) for a, n in k for x, col in ((a, present), (n - a, z - present)) if x > 0)
        if len(k) > 1:
            log_p += float(M.chi2_log_sf(np.array([g]), len(k) - 1)[0])
    motif = row["motif"]
    d = sum({1: 0, 2: 1, 3: 2, 4: 3}[len(_IUPAC[x])] for x in motif)
    return Found(motif, row["score"], log_p + M.correction(len(motif), d, opt.fixed_correction), {(c, s): row[f"{c}:{s}"] for c, sets in sizes.items() for s, _ in sets})


def score_motif(seqs: DataFrame, motif: str, objective: Objective, opt: Options) -> Found:
    """The score of an explicit pattern."""
    sizes = sizes_of(seqs, opt.per_occurrence, len(motif))
    wide = wide_counts(motif_counts(seqs, [motif], opt.both_strands, opt.per_occurrence), sizes, "motif")
    return _found(wide.withColumn("score", score_column(sizes, objective, opt.pseudo_count, opt.enriched_only)).first(), sizes, objective, opt)


def find_multiple(seqs: DataFrame, lengths: list[int], times: int, objective: Objective, opt: Options, each_length: bool = False) -> list[Found]:
    """The best pattern over all lengths (or for each length), masked or removed, and again, ``times`` times.

    ``log_p`` is ln of the chance under independence, corrected for the number of words tried; with ``strict`` only
    patterns where it is below 0 are reported. Results are ordered by it.
    """
    out: list[Found] = []
    groups = [[k] for k in lengths] if each_length else [lengths]
    for group in groups:
        rest = seqs
        for _ in range(times):
            found = []
            for k in group:
                seeds = find_seeds(rest, k, objective, opt)
                row = seeds.orderBy(F.desc("score"), "motif").first()
                if row:
                    found.append(_found(row, sizes_of(rest, opt.per_occurrence, k), objective, opt))
            if opt.strict:
                found = [f for f in found if f.log_p < 0]
            if not found:
                break
            best = min(found, key=lambda f: (-f.score, f.motif))
            out.append(best)
            rest = (mask_motif if opt.mode == "mask" else remove_motif)(rest, best.motif, opt.both_strands)
    return sorted(out, key=lambda f: (f.log_p, f.motif))


def first_wins(*results: DataFrame) -> DataFrame:
    """Union of the results of several algorithms; of rows with the same motif that of the first one stays."""
    both = None
    for i, r in enumerate(results):
        r = r.withColumn("__order", F.lit(i))
        both = r if both is None else both.unionByName(r)
    w = Window.partitionBy("motif").orderBy("__order")
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__order")


from ..functions.alphabet import IUPAC as _IUPAC  # noqa: E402
