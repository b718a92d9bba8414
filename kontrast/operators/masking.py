"""Hiding or dropping what has been found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import to_regex
from .counting import twin


def _covered(motif: str) -> str:
    """A regular expression for each character that an occurrence covers: the occurrence may begin up to its length
    before, so overlapping ones are all seen in one pass."""
    classes = [to_regex(x) for x in motif]
    return "|".join(f"(?<={''.join(classes[:k])})(?={''.join(classes[k:])})" if k else f"(?={''.join(classes)})" for k in range(len(classes)))


def mask_motif(seqs: DataFrame, motif: str, both_strands: bool = False, mark: str = "-") -> DataFrame:
    """All occurrences of a pattern, overlapping ones too, replaced by a mark."""
    forms = [_covered(m) for m in dict.fromkeys([motif, twin(motif)] if both_strands else [motif])]
    return seqs.withColumn("sequence", F.regexp_replace("sequence", f"(?:{'|'.join(forms)}).", mark))


def remove_motif(seqs: DataFrame, motif: str, both_strands: bool = False) -> DataFrame:
    """Without the sequences that hold a pattern."""
    hit = F.regexp_like("sequence", F.lit(to_regex(motif)))
    return seqs.where(~(hit | F.regexp_like("sequence", F.lit(to_regex(twin(motif)))) if both_strands else hit))


def mask_positions(seqs: DataFrame, mask: DataFrame, mark: str = "n") -> DataFrame:
    """``mask`` (seq_id, pos): 0-based positions to hide; a position past the end counts back from the end."""
    spots = mask.groupBy("seq_id").agg(F.collect_set(F.col("pos").cast("int")).alias("__spots"))
    letters = F.transform(F.split("sequence", ""), lambda c, i: F.struct(i.alias("at"), F.lit(1).alias("kind"), c.alias("c")))
    hidden = lambda n: F.transform("__spots", lambda p: F.struct(F.when(p < n, p).otherwise(2 * n - p).alias("at"), F.lit(0).alias("kind"), F.lit(mark).alias("c")))
    inside = lambda n: F.filter(hidden(n), lambda x: (x["at"] >= 0) & (x["at"] < n))
    # a transform over one element holds a value that would otherwise be worked out again for each letter
    both = F.transform(F.array(F.char_length("sequence")), lambda n: F.array_sort(F.concat(inside(n), letters)))
    # marks stand before the letters of their places, of which only the first entry of each stays: no letter is searched for
    left = F.transform(both, lambda a: F.array_join(F.transform(F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1)["at"] != x["at"])), lambda x: x["c"]), ""))
    rows = seqs.join(spots, "seq_id", "left")
    return rows.withColumn("sequence", F.when(F.col("__spots").isNull() | (F.col("sequence") == ""), F.col("sequence")).otherwise(left[0])).drop("__spots").select(*seqs.columns)


def drop_sequences(seqs: DataFrame, mask: DataFrame) -> DataFrame:
    return seqs.join(mask.select("seq_id").distinct(), "seq_id", "left_anti").select(*seqs.columns)


def removal_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """(contrast, set_id, sequences, nucleotides): what a step removed or hid, as counts of rows and of bases."""
    bases = F.sum(F.char_length("sequence") - F.char_length(F.translate("sequence", "acgt", "")))
    size = lambda df, p: df.groupBy("contrast", "set_id").agg(F.count(F.lit(1)).alias(f"{p}s"), bases.alias(f"{p}n"))
    both = size(before, "b").join(size(after, "a"), ["contrast", "set_id"], "left")
    return both.select("contrast", "set_id", (F.col("bs") - F.coalesce("as", F.lit(0))).alias("sequences"), (F.col("bn") - F.coalesce("an", F.lit(0))).alias("nucleotides"))
