"""What a search has found, as tables: reports, BED lines, annotated sequences, matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions.alphabet import CODE, degeneracy, information_content, regex_column
from .counting import motif_counts, occurrences_of
from .search import Objective, Options, ordered, sizes_of, wide_counts


def seed_report(seqs: DataFrame, motifs: list[str], opt: Options | None = None, signals: dict[str, list[int]] | None = None) -> DataFrame:
    """(motif, contrast, regex, length, ic, degeneracy, mi, g, mcc, dfreq, chisq, log_p, counts) for each pattern and contrast.

    ``counts`` has the sets' numbers, the signal's first, with the sequences (or occurrences) that hold the pattern and
    all of them. ``log_p`` is corrected for the number of words of that length and degeneracy.
    """
    opt = opt or Options()
    sizes = sizes_of(seqs, opt.per_occurrence, len(motifs[0])) if motifs else {}
    wide = wide_counts(motif_counts(seqs, motifs, opt.both_strands, opt.per_occurrence), sizes, "motif")
    out = None
    for c, sets in ordered(sizes, signals).items():
        cells = [(F.least(F.col(f"`{c}:{s}`"), F.lit(n)), F.lit(n)) for s, n in sets]
        ps = opt.pseudo_count
        two = len(sets) == 2
        none = F.lit(None).cast("double")
        counts = F.array(*[F.struct(F.lit(s).alias("set_id"), F.col(f"`{c}:{s}`").alias("with_motif"), F.lit(n).cast("long").alias("all")) for s, n in sets])
        part = wide.select(
            "motif", F.lit(c).alias("contrast"), regex_column(F.col("motif")).alias("regex"), F.char_length("motif").alias("length"), information_content(F.col("motif")).alias("ic"), degeneracy(F.col("motif")).alias("degeneracy"),
            M.mutual_information(cells, ps).alias("mi"), M.g_statistic(cells, ps).alias("g"), (M.mcc(cells) if two else none).alias("mcc"), (M.delta_frequency(cells) if two else none).alias("dfreq"), (M.chi_square(cells) if two else none).alias("chisq"), counts.alias("counts"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def bed(occurrences: DataFrame, name: str = "site") -> DataFrame:
    """(seq_id, start, end, name, score, strand) of occurrences, numbered within a sequence by place; overlapping ones are kept."""
    from pyspark.sql import Window

    at = Window.partitionBy("seq_id").orderBy("pos", "end", "motifname", "strand")
    return occurrences.select("seq_id", F.col("pos").alias("start"), "end", F.concat(F.lit(f"{name}_"), F.row_number().over(at) - 1).alias("name"), F.lit(0).alias("score"), "strand")


def annotated(seqs: DataFrame, motifs: list[str]) -> DataFrame:
    """``seqs`` with a column ``marks``: over each letter the letter A, B, .. of the last pattern that covers it, or a point."""
    rows = seqs.withColumn("marks", F.transform(F.split("sequence", ""), lambda c: F.lit(".")))
    for k, m in enumerate(motifs):
        covered = F.flatten(F.transform(occurrences_of(F.col("sequence"), m), lambda i: F.sequence(i - 1, i + len(m) - 2)))
        spots = F.transform(F.array_distinct(covered), lambda i: F.struct(i.alias("at"), F.lit(0).alias("kind"), F.lit(chr(65 + k % 26)).alias("c")))
        letters = F.transform("marks", lambda c, i: F.struct(i.alias("at"), F.lit(1).alias("kind"), c.alias("c")))
        both = F.transform(F.array(F.array_sort(F.concat(spots, letters))), lambda a: F.transform(F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1)["at"] != x["at"])), lambda x: x["c"]))
        rows = rows.withColumn("marks", both[0])
    return rows.withColumn("marks", F.when(F.col("sequence") == "", "").otherwise(F.array_join("marks", "")))


def matrix_of(word: str) -> list[tuple[int, float, float, float, float]]:
    """(pos, a, c, g, t) of a pattern: the bases that a letter allows share it evenly."""
    return [(i, *(float(bool(CODE[x] & bit)) / CODE[x].bit_count() for bit in (1, 2, 4, 8))) for i, x in enumerate(word)]


def shifted_positions(positions: Column, by: int, size: Column) -> Column:
    """Places moved by ``by``, without those that leave the sequence."""
    return F.filter(F.transform(positions, lambda p: p + by), lambda p: (p >= 0) & (p < size))


def signals_of(sets: list, motif: str) -> dict[str, list[int]]:
    """{contrast: numbers of the sets that name the pattern}, for specs as ``harmonised`` gives them."""
    out: dict[str, list[int]] = {}
    count: dict[str, int] = {}
    for s in sets:
        i = count.setdefault(s.contrast, 0)
        count[s.contrast] += 1
        if motif in s.motifs:
            out.setdefault(s.contrast, []).append(i)
    return out
