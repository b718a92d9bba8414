"""Words and patterns counted over sets of sequences."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import IUPAC, canonical, packed, reverse_complement, to_regex

#: Pairs of pattern and word that are sent to the tasks at most; more are joined.
MOST_HITS = 2_000_000


def set_sizes(seqs: DataFrame) -> DataFrame:
    """(contrast, set_id, set_size, seq_size): number of sequences and their total length."""
    return seqs.groupBy("contrast", "set_id").agg(F.count(F.lit(1)).alias("set_size"), F.sum(F.char_length("sequence")).alias("seq_size"))


def set_digests(seqs: DataFrame, block: int = 1000) -> DataFrame:
    """(contrast, set_id, digest): SHA-1 over the SHA-1s of blocks of sequences in rank order, so no set meets in one task."""
    blocks = seqs.groupBy("contrast", "set_id", F.floor(F.col("rank") / block).alias("block")).agg(F.array_sort(F.collect_list(F.struct("rank", "sequence"))).alias("x"))
    blocks = blocks.select("contrast", "set_id", "block", F.sha1(F.concat_ws("", F.transform("x", lambda r: r["sequence"])).cast("binary")).alias("d"))
    return blocks.groupBy("contrast", "set_id").agg(F.sha1(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("block", "d"))), lambda r: r["d"])).cast("binary")).alias("digest"))


def windows(seq: Column, k: int, letter: str = ".") -> Column:
    """All words of length k of a sequence, in order, whose characters match ``letter``; one pass over the sequence."""
    return F.regexp_extract_all(seq, F.lit(f"(?s)(?=({letter}{{{k}}}))"), F.lit(1))


def word_lists(seqs: DataFrame, k: int, both_strands: bool = False, per_occurrence: bool = False) -> DataFrame:
    """(contrast, set_id, seq_id, words): distinct pure words of each sequence, or each occurrence.

    With both strands a word stands for itself and its reverse complement; by occurrence a palindrome counts once.
    """
    w = windows(F.col("sequence"), k, "[acgt]")
    if both_strands:
        w = F.transform(w, canonical)
    return seqs.select("contrast", "set_id", "seq_id", (w if per_occurrence else F.array_distinct(w)).alias("words"))


def words(seqs: DataFrame, k: int, both_strands: bool = False, per_occurrence: bool = False) -> DataFrame:
    """(contrast, set_id, seq_id, word): a row for each of ``word_lists``; nothing is shuffled."""
    return word_lists(seqs, k, both_strands, per_occurrence).select("contrast", "set_id", "seq_id", F.explode("words").alias("word"))


def occurrences_of(seq: Column, motif: str) -> Column:
    """1-based starts of a pattern in a sequence, overlaps included; one pass over the sequence."""
    starts = F.transform(windows(seq, len(motif)), lambda w, i: F.when(F.regexp_like(w, F.lit(f"^{to_regex(motif)}$")), i + 1))
    return F.filter(starts, lambda i: i.isNotNull())


def twin(motif: str) -> str:
    from ..functions.alphabet import COMPLEMENT

    return "".join(COMPLEMENT[x] for x in reversed(motif))


def motif_count(seq: Column, motif: str, both_strands: bool = False, per_occurrence: bool = False) -> Column:
    """How often a pattern stands in a sequence; without ``per_occurrence`` 0 or 1, by one regular expression."""
    other = twin(motif)
    if not per_occurrence:
        hit = F.regexp_like(seq, F.lit(to_regex(motif)))
        return (hit | F.regexp_like(seq, F.lit(to_regex(other))) if both_strands else hit).cast("int")
    count = lambda m: F.regexp_count(seq, F.lit(f"(?={to_regex(m)})"))
    return count(motif) + count(other) if both_strands and other != motif else count(motif)


def motif_counts(seqs: DataFrame, motifs: list[str], both_strands: bool = False, per_occurrence: bool = False) -> DataFrame:
    """(contrast, set_id, motif, n) of explicit patterns in one pass over the sequences."""
    sums = [F.sum(motif_count(F.col("sequence"), m, both_strands, per_occurrence)).cast("long").alias(f"n{i}") for i, m in enumerate(motifs)]
    wide = seqs.groupBy("contrast", "set_id").agg(*sums)
    return wide.select("contrast", "set_id", F.explode(F.array(*[F.struct(F.lit(m).alias("motif"), F.col(f"n{i}").alias("n")) for i, m in enumerate(motifs)])).alias("x")).select("contrast", "set_id", "x.*")


_BASE = np.full(256, 4, np.uint8)
_BASE[[ord(x) for x in "acgt"]] = range(4)
#: Letters whose words are numbered at a time.
PIECE = 2_000_000


def word_codes(seqs: list[str], k: int, both_strands: bool, per_occurrence: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, word, n) of the pure words of length k, as numbers of base 4, with their occurrences or else 1.

    Memory follows the distinct words of the sequences and PIECE, not the length of a sequence.
    """
    data = [s.encode("utf-8") + b" " for s in seqs]
    text, ends = np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(x) for x in data])
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for begin in range(0, max(0, len(text) - k + 1), PIECE):
        base = _BASE[text[begin : begin + PIECE + k - 1]]
        bad = np.append(0, np.cumsum(base == 4, dtype=np.int32))
        at = np.flatnonzero(bad[k:] == bad[: max(0, len(bad) - k)])
        code, twin = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for j in range(k):
            x = base[at + j].astype(np.int64)
            code += x << (2 * (k - 1 - j))
            if both_strands:
                twin += (3 - x) << (2 * j)
        code = np.minimum(code, twin) if both_strands else code
        key, n = np.unique((np.searchsorted(ends, begin + at, side="right") << (2 * k)) | code, return_counts=True)
        keys.append(key)
        counts.append(n)
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(back, np.concatenate(counts), len(key)).astype(np.int64) if per_occurrence else np.ones(len(key), np.int64)
    return key >> (2 * k), key & ((1 << (2 * k)) - 1), n


def pure_words(form: str) -> np.ndarray:
    """The words that a pattern stands for, as numbers of base 4."""
    out = np.zeros(1, np.int64)
    for x in form:
        out = (out[:, None] * 4 + np.array(["acgt".index(b) for b in IUPAC[x]])).ravel()
    return out


def batches_of(seqs: DataFrame, run, schema: str) -> DataFrame:
    """``run`` (batch, sequences) over parts of some million letters of (contrast, set_id, sequence)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = [s or "" for s in b.column("sequence").to_pylist()]
            begin, held = 0, 0
            for i, s in enumerate(q):
                held += len(s)
                if held > 1_000_000 or i == len(q) - 1:
                    yield run(b.slice(begin, i + 1 - begin), q[begin : i + 1])
                    begin, held = i + 1, 0

    rows = seqs.select(F.col("contrast").cast("string").alias("contrast"), F.col("set_id").cast("int").alias("set_id"), "sequence")
    return rows.mapInArrow(each, schema)


def sets_in(b: pa.RecordBatch) -> tuple[list[tuple[str, int]], np.ndarray]:
    """The sets of a batch, and the number among them of each row's."""
    sets = list(zip(b.column("contrast").to_pylist(), b.column("set_id").to_pylist(), strict=True))
    which = {s: i for i, s in enumerate(dict.fromkeys(sets))}
    return list(which), np.array([which[s] for s in sets], np.int64)


def word_counts(seqs: DataFrame, k: int, both_strands: bool = False, per_occurrence: bool = False) -> DataFrame:
    """(contrast, set_id, word, n). Words of up to 15 letters are numbered and counted in the tasks, in numpy, so that what
    is shuffled are the counts of each task's distinct words; longer ones are rows of ``words``, summed before the shuffle."""
    if k > 15:
        return words(seqs, k, both_strands, per_occurrence).groupBy("contrast", "set_id", "word").agg(F.count(F.lit(1)).alias("n"))

    def counted(b: pa.RecordBatch, q: list[str]) -> pa.RecordBatch:
        which, own = sets_in(b)
        row, code, n = word_codes(q, k, both_strands, per_occurrence)
        cell, back = np.unique((own[row] << (2 * k)) | code, return_inverse=True)
        n = np.bincount(back, n, len(cell))
        sets = [which[i] for i in cell >> (2 * k)]
        cols = [pa.array([c for c, _ in sets], pa.string()), pa.array([s for _, s in sets], pa.int32()), pa.array(cell & ((1 << (2 * k)) - 1)), pa.array(n.astype(np.int64))]
        return pa.RecordBatch.from_arrays(cols, names=["contrast", "set_id", "code", "n"])

    sums = batches_of(seqs, counted, "contrast string, set_id int, code long, n long").groupBy("contrast", "set_id", "code").agg(F.sum("n").alias("n"))
    word = F.translate(F.lpad(F.conv(F.col("code").cast("string"), 10, 4), k, "0"), "0123", "acgt")
    return sums.select("contrast", "set_id", word.alias("word"), "n")


def pattern_hits(seqs: DataFrame, forms: DataFrame, k: int, both_strands: bool = False, per_occurrence: bool = False) -> DataFrame:
    """(pattern, contrast, set_id, word_hits, seq_hits) of ambiguity patterns among the words of sequences, see ``word_lists``.

    ``forms`` (pattern, form) is a bounded beam; a pure word matches a pattern if one of its forms stands for it. Up to
    MOST_HITS pairs of pattern and word are sent to the tasks, which look each row's words up and sum up before anything
    is shuffled; more are found from the distinct words, at most 4**k whatever the input, and joined with the words.
    """
    beam = forms.select("pattern", "form").distinct().collect()
    if sum(math.prod(len(IUPAC[x]) for x in r["form"]) for r in beam) > MOST_HITS:
        lists = word_lists(seqs, k, both_strands, per_occurrence)
        coded = lists.select(F.explode("words").alias("word")).distinct().select("word", packed(F.col("word"), k).alias("w"))
        wanted = forms.select("pattern", packed(F.col("form"), k).alias("p"))
        hits = coded.join(F.broadcast(wanted), F.col("w").bitwiseAND(F.col("p")) == F.col("w")).select("pattern", "word").distinct()
        per_seq = lists.select("contrast", "set_id", "seq_id", F.explode("words").alias("word")).join(hits, "word").groupBy("pattern", "contrast", "set_id", "seq_id").agg(F.count(F.lit(1)).alias("n"))
        return per_seq.groupBy("pattern", "contrast", "set_id").agg(F.sum("n").alias("word_hits"), F.count(F.lit(1)).alias("seq_hits"))

    names = sorted({r["pattern"] for r in beam})
    number = {x: i for i, x in enumerate(names)}
    words_ = [pure_words(r["form"]) for r in beam]
    owners = [np.full(len(w), number[r["pattern"]], np.int64) for w, r in zip(words_, beam, strict=True)]
    both = np.unique(np.stack([np.concatenate(words_), np.concatenate(owners)]), axis=1) if beam else np.zeros((2, 0), np.int64)
    known, first = np.unique(both[0], return_index=True)
    shared = seqs.sparkSession.sparkContext.broadcast((known, np.append(first, both.shape[1]), both[1], names))

    def counted(b: pa.RecordBatch, q: list[str]) -> pa.RecordBatch:
        known, ends, owner, names = shared.value
        row, code, times = word_codes(q, k, both_strands, per_occurrence)
        at = np.searchsorted(known, code)
        hit = np.append(known, -1)[at] == code
        row, at, times = row[hit], at[hit], times[hit]
        n = ends[at + 1] - ends[at]
        start = np.repeat(ends[at] - np.cumsum(n) + n, n)
        key, back = np.unique(np.repeat(row, n) * len(names) + owner[start + np.arange(len(start))], return_inverse=True)
        n = np.bincount(back, np.repeat(times, n), len(key))
        which, own = sets_in(b)
        wide = max(1, len(names))
        cell, back = np.unique(own[key // wide] * wide + key % wide, return_inverse=True)
        cols = [pa.array([names[i % len(names)] for i in cell], pa.string()), pa.array([which[i // len(names)][0] for i in cell], pa.string()), pa.array([which[i // len(names)][1] for i in cell], pa.int32())]
        cols += [pa.array(np.bincount(back, n, len(cell)).astype(np.int64)), pa.array(np.bincount(back, minlength=len(cell)).astype(np.int64))]
        return pa.RecordBatch.from_arrays(cols, names=["pattern", "contrast", "set_id", "word_hits", "seq_hits"])

    partial = batches_of(seqs, counted, "pattern string, contrast string, set_id int, word_hits long, seq_hits long")
    return partial.groupBy("pattern", "contrast", "set_id").agg(F.sum("word_hits").alias("word_hits"), F.sum("seq_hits").alias("seq_hits"))


def occurrence_table(seqs: DataFrame, motifs: dict[str, str], both_strands: bool = False) -> DataFrame:
    """(seq_id, pos, end, motifname, motif, strand, forwardpos, centerdist): all matches, 0-based, overlaps kept.

    Matches of the other strand are found on the given one by the reverse complement of the pattern, so ``pos`` and
    ``forwardpos`` both are the place on the forward strand.
    """
    def places(name: str, motif: str, strand: str, form: str) -> Column:
        return F.transform(occurrences_of(F.col("sequence"), form), lambda i: F.struct((i - 1).alias("pos"), F.lit(name).alias("motifname"), F.lit(motif).alias("motif"), F.lit(strand).alias("strand")))

    found = []
    for name, motif in motifs.items():
        found.append(places(name, motif, "+", motif))
        if both_strands and twin(motif) != motif:
            found.append(places(name, motif, "-", twin(motif)))
    rows = seqs.select("contrast", "set_id", "seq_id", F.char_length("sequence").alias("len"), F.explode(F.concat(*found)).alias("x")).select("contrast", "set_id", "seq_id", "len", "x.*")
    size = F.char_length("motif")
    return rows.select("contrast", "set_id", "seq_id", "pos", (F.col("pos") + size).alias("end"), "motifname", "motif", "strand", F.col("pos").alias("forwardpos"), (F.col("pos") + size / 2.0 - F.col("len") / 2.0).alias("centerdist"))


def both_strand_sequence(seqs: DataFrame) -> DataFrame:
    return seqs.withColumn("sequence", F.concat("sequence", F.lit("$"), reverse_complement(F.col("sequence"))))
