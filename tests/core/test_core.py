import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kontrast.functions import alphabet as A
from kontrast.functions import measures as M
from kontrast.operators import association as S
from kontrast.operators import counting as C
from kontrast.operators import masking, sampling, search
from kontrast.sources import specs
from kontrast.sources.fasta import read_fasta, read_matrix, scratch, write_fasta


def cells(*rows):
    return [(F.lit(k), F.lit(k + a)) for k, a in rows]


def value(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def make(spark, sets, contrast="c"):
    rows = [(contrast, s, 1000 * s + i, i, f"r{s}_{i}", q) for s, seqs in enumerate(sets) for i, q in enumerate(seqs)]
    return spark.createDataFrame(rows, "contrast string, set_id int, seq_id long, rank long, definition string, sequence string")


def test_measure_goldens(spark):
    t = cells((30, 70), (10, 90))
    three = cells((30, 70), (10, 90), (20, 80))
    got = [value(spark, c) for c in (M.mutual_information(t, 0), M.g_statistic(t, 0), M.mutual_information(t), M.g_statistic(t), M.corrected_mi(t), M.corrected_mi(t, form="model"), M.mcc(t), M.delta_frequency(t), M.mutual_information(three))]
    want = [0.04678484847737535, 12.97151432600679, 0.04383411247990208, 12.396464522938986, 0.04871216126038988, 0.04627313687014598, 0.25, 0.2, 0.029222741653268013]
    assert got == pytest.approx(want, rel=1e-12)
    assert value(spark, M.raw_log_p(t)) == pytest.approx(7.7513823929960175, rel=1e-10)
    assert value(spark, M.raw_log_p(three)) == pytest.approx(6.198232261469486, rel=1e-12)
    assert [M.words_up_to(n, d) for n in (1, 2) for d in range(3 * n + 1)] == [4, 10, 14, 15, 16, 64, 132, 188, 216, 224, 225]
    assert M.correction(8, 3, fixed=True) == pytest.approx(5.003946305945459)
    x = np.array([0.1, 1.0, 3.84, 50.0, 3000.0])
    assert M.chi2_log_sf(x[:4], 1) == pytest.approx([math.log(math.erfc(math.sqrt(v / 2))) for v in x[:4]], rel=1e-9)
    assert M.chi2_log_sf(x, 2) == pytest.approx(-x / 2, rel=1e-12)
    assert value(spark, M.measure("mi", cells((1, 2)))) == -math.inf
    assert value(spark, M.measure("mi", cells((1, 9), (5, 5)), 1.0, True)) == -math.inf
    with pytest.raises(ValueError):
        M.measure("none", t)


def test_strands_and_codes(spark):
    w = ["acgt", "rwnacg", "ttnbvhd", "a"]
    df = spark.createDataFrame([(x,) for x in w], "w string")
    assert [r[0] for r in df.select(A.reverse_complement(A.reverse_complement(F.col("w")))).collect()] == w
    assert [r[0] for r in df.select(A.degeneracy(F.col("w"))).collect()] == [0, 5, 11, 0]
    assert value(spark, A.included(F.lit("a"), F.lit("r"))) and not value(spark, A.included(F.lit("c"), F.lit("r")))
    kids = {r.child for r in A.generalizations(spark.createDataFrame([("an",)], "w string"), "w").collect()}
    assert kids == {"mn", "rn", "wn"}
    assert value(spark, A.normalized(F.lit("ACGU"))) == "acgt"
    with pytest.raises(ValueError):
        A.packed(F.lit("a"), 16)


def test_alphabet_queries_take_whole_words(spark):
    from kontrast import queries as Q

    at = "/root/testdata/sf0.001"
    words = {r.word for r in Q._letters(spark, at).collect()}
    more = {x: [A.LETTER[A.CODE[x] | bit] for bit in (1, 2, 4, 8) if not A.CODE[x] & bit] for x in A.IUPAC}
    kids = {(w, w[:i] + y + w[i + 1 :]) for w in words for i in range(len(w)) for y in more[w[i]]}
    assert {tuple(r) for r in Q.QUERIES["all_generalizations_whole"](spark, at).collect()} == kids
    shifts = sorted((w, "n" * s + w[: len(w) - s] if s >= 0 else w[-s:] + "n" * -s) for w in words if len(w) > 1 for s in range(-2, 3))
    assert sorted(tuple(r) for r in Q.QUERIES["wiggle_variants_whole"](spark, at).collect()) == shifts
    windows = {w[i : i + 5] for w in words for i in range(len(w) - 4)}
    assert {(r.word, r.back) for r in Q.QUERIES["packed_codes_all_windows"](spark, at).collect()} == {(w, w) for w in windows}


def test_counting_edges(spark):
    s = make(spark, [["aaaa", "acgt", "a", "", "anaaa"]])
    by = lambda **k: {r.word: r.n for r in C.word_counts(s, 2, **k).collect()}
    assert by()["aa"] == 2 and by(per_occurrence=True)["aa"] == 5
    assert by(both_strands=True)["ac"] == 1
    n = {r.motif: r.n for r in C.motif_counts(s, ["aa", "acgt", "an"], per_occurrence=True).collect()}
    assert n["aa"] == 5 and n["acgt"] == 1
    assert C.word_counts(s.limit(0), 3).count() == 0
    assert [r.sequence for r in masking.mask_motif(make(spark, [["tatatc", "cctat"]]), "tat").orderBy("seq_id").collect()] == ["-----c", "cc---"]
    assert masking.remove_motif(s, "aaa").count() == 3


def enumerate_best(sets, k, enriched=True):
    sizes = [len(x) for x in sets]
    best = []
    for w in itertools.product(A.LETTERS, repeat=k):
        ks = [sum(any(all(b in A.IUPAC[x] for x, b in zip(w, q[i : i + k])) for i in range(len(q) - k + 1)) for q in x) for x in sets]
        if enriched and ks[0] / sizes[0] < ks[1] / sizes[1]:
            continue
        cells_ = [(a + 1, n + 2) for a, n in zip(ks, sizes)]
        z, p = sum(n for _, n in cells_), sum(a for a, _ in cells_)
        best.append((sum(v / z * math.log2(v * z / (n * c)) for a, n in cells_ for v, c in ((a, p), (n - a, z - p))), "".join(w)))
    return best


def test_wide_beam_equals_enumeration(spark):
    rng = random.Random(1)
    sets = [["".join(rng.choice("acgt") for _ in range(12)) + ("tga" if i % 2 else "tca") for i in range(24)], ["".join(rng.choice("acgt") for _ in range(15)) for _ in range(24)]]
    want = enumerate_best(sets, 2)
    got = {r.motif: r.score for r in search.find_seeds(make(spark, sets), 2, search.Objective("mi"), search.Options(candidates=1000)).collect()}
    scores = {w: s for s, w in want}
    assert all(s == pytest.approx(scores[w]) for w, s in got.items())
    assert max(got.values()) == pytest.approx(max(s for s, _ in want))


def test_planted_motif_is_found_masked_and_scored(spark):
    rng = random.Random(2)
    back = lambda n: "".join(rng.choice("acgt") for _ in range(n))
    s = make(spark, [[back(20) + "tgtaa" + back(20) for _ in range(40)], [back(45) for _ in range(40)]])
    found = search.find_multiple(s, [5], 2, search.Objective("mi"), search.Options(candidates=5, max_degeneracy=1))
    assert any(f.motif == "tgtaa" or f.score > 0.6 for f in found)
    one = search.score_motif(s, "tgtaa", search.Objective("mi"), search.Options())
    assert one.counts["c", 0] == 40 and one.log_p < 0
    with pytest.raises(ValueError):
        search.score_motif(s, "tgtaa", search.Objective("mi", {"other": 1}), search.Options())
    both = search.first_wins(spark.createDataFrame([("a", 1.0)], "motif string, score double"), spark.createDataFrame([("a", 2.0), ("b", 3.0)], "motif string, score double"))
    assert sorted(map(tuple, both.collect())) == [("a", 1.0), ("b", 3.0)]


def test_shuffle_keeps_pairs_and_control_is_added(spark):
    rng = random.Random(3)
    pairs = lambda q: Counter(zip(q, q[1:]))
    for n in (0, 1, 2, 3, 50, 300):
        q = "".join(rng.choice("acgtn") for _ in range(n))
        for seed in range(5):
            out = sampling.shuffle_dinucleotides(q, seed)
            assert pairs(out) == pairs(q) and out[:1] == q[:1]
    assert sampling.shuffle_dinucleotides("a" * 30, 1) == "a" * 30
    s = make(spark, [["acgtacgtgacgt" * 3, "aaaa"]])
    both = sampling.with_control(s)
    assert both.where("set_id = 1").count() == 2 and sampling.with_control(both).count() == 4


def test_fasta_round_trip_and_errors(spark):
    s = make(spark, [["acgt" * 50, "ACGUN".lower(), "n"]]).withColumn("definition", F.concat("definition", F.lit(" a > b")))
    for codec in (None, "gzip", "bzip2"):
        path = scratch(spark, "fa")
        write_fasta(s, path, codec, width=60)
        rows = read_fasta(spark, path).orderBy("rank").collect()
        assert [r["rank"] for r in rows] == [0, 1, 2] and rows[0].definition == "r0_0 a > b"
        assert [r.sequence for r in rows] == ["acgt" * 50, "acgtn", "n"]
    assert read_fasta(spark, path, n_seq=2).count() == 2
    assert read_fasta(spark, path, both_strands=True).orderBy("rank").first().sequence.endswith("$" + "acgt" * 50)
    bad = scratch(spark, "bad")
    spark.createDataFrame([(">x\nac5",)], "value string").write.text(bad)
    with pytest.raises(Exception, match="no nucleotide"):
        read_fasta(spark, bad).collect()
    m = scratch(spark, "matrix")
    spark.createDataFrame([("x A C G T",), ("0 0.1 0.2 0.3 0.4",), ("1 1 0 0 0",), ("2 0.5 0.5 0.5 0.5",)], "value string").coalesce(1).write.text(m)
    assert [tuple(r) for r in read_matrix(spark, m).orderBy("pos").collect()] == [(0, 0.1, 0.2, 0.3, 0.4), (1, 1.0, 0.0, 0.0, 0.0)]


def test_specs():
    assert specs.parse_list("5-7,9") == [5, 6, 7, 9]
    d = specs.parse_dataset("RBM10,PUM:Exp1:sig.fa")
    assert (d.motifs, d.contrast, d.path, d.is_control) == (["RBM10", "PUM"], "Exp1", "sig.fa", False)
    assert specs.parse_dataset("control:Exp1:ctl.fa").is_control
    m = specs.parse_motif("signal:2,3:5-9x3")
    assert (m.name, m.insertions, m.lengths, m.multiplicity, m.kind) == ("signal", [2, 3], [5, 6, 7, 8, 9], 3, "search")
    assert specs.parse_motif("tgtanatw").kind == "seed"
    o = specs.parse_objective("Nanog:+A+B-C:mi")
    assert (o.motif, o.contrasts, o.measure) == ("Nanog", {"A": 1, "B": 1, "C": -1}, "mi")
    for bad in ("A:+:mi", "none"):
        with pytest.raises(ValueError):
            specs.parse_objective(bad)


def test_ranks_and_positions(spark):
    s = make(spark, [["acgtac"] * 5])
    hidden = masking.mask_positions(s, spark.createDataFrame([(0, 0), (0, 8)], "seq_id long, pos int")).orderBy("seq_id").collect()
    assert hidden[0].sequence == "ncgtnc" and hidden[1].sequence == "acgtac"
    rows = spark.createDataFrame([(0, i, float(i < 5)) for i in range(10)], "g int, rank long, x double")
    small = S.prefix_sums(rows, ["g"], "rank", "x", block=3).orderBy("rank").collect()
    assert [r.upto for r in small] == [1, 2, 3, 4, 5, 5, 5, 5, 5, 5] and [r.place for r in small] == list(range(1, 11))
    t = S.tied_ranks(spark.createDataFrame([(0, v) for v in (1, 2, 2, 3)], "g int, v int"), ["g"], "v", "r").orderBy("v").collect()
    assert [r.r for r in t] == [1, 2.5, 2.5, 4]


def test_long_sequences_take_one_pass(spark):
    """A sequence of a million letters: words, places, a matrix and a mask, each in time linear in its length."""
    import random
    import time

    rng = random.Random(8)
    long = "".join(rng.choice("acgt") for _ in range(1_000_000))
    seqs = spark.createDataFrame([("c", 0, 1, long)], "contrast string, set_id int, seq_id long, sequence string")
    want = {}
    for i in range(len(long) - 3):
        want[long[i : i + 4]] = want.get(long[i : i + 4], 0) + 1
    C.word_counts(seqs, 4).count()
    began = time.time()
    assert {r.word: r.n for r in C.word_counts(seqs, 4, per_occurrence=True).collect()} == want
    places = [r.pos for r in C.occurrence_table(seqs, {"m": "acgta"}).select("pos").collect()]
    assert places == [i for i in range(len(long)) if long.startswith("acgta", i)]
    assert C.motif_counts(seqs, ["acgta"], per_occurrence=True).first().n == len(places)
    best = S.pwm_scan(seqs, [[0.7, 0.1, 0.1, 0.1]] * 4).agg(F.max("p").alias("p"), F.count(F.lit(1)).alias("n")).first()
    assert abs(best.p - 0.7**4) < 1e-12 and best.n == len(long) - 3
    spots = spark.range(0, 1_000_000, 2).select(F.lit(1).cast("long").alias("seq_id"), F.col("id").alias("pos"))
    hidden = masking.mask_positions(seqs, spots).first().sequence
    assert hidden == "".join("n" if i % 2 == 0 else x for i, x in enumerate(long))
    assert time.time() - began < 60


def test_places_on_the_forward_strand(spark):
    """A match of the other strand is reported where it stands on the given one."""
    seqs = spark.createDataFrame([("c", 0, 1, "ttacgtcaaaa"), ("c", 0, 2, "tgacgtaa")], "contrast string, set_id int, seq_id long, sequence string")
    got = sorted((r.seq_id, r.strand, r.pos, r.end, r.forwardpos) for r in C.occurrence_table(seqs, {"m": "gtca"}, both_strands=True).collect())
    assert got == [(1, "+", 4, 8, 4), (2, "-", 0, 4, 0)]


def test_hits_of_many_patterns_are_joined(spark, monkeypatch):
    seqs = spark.createDataFrame([("c", i % 2, i, "acgtacgatt"[i:] + "ccgt") for i in range(6)], "contrast string, set_id int, seq_id long, sequence string")
    forms = spark.createDataFrame([("nngn", "nngn"), ("acgt", "acgt"), ("wwww", "wwww")], "pattern string, form string")
    for both in (False, True):
        few = sorted(tuple(r) for r in C.pattern_hits(seqs, forms, 4, both, both).collect())
        monkeypatch.setattr(C, "MOST_HITS", 0)
        assert few == sorted(tuple(r) for r in C.pattern_hits(seqs, forms, 4, both, both).collect()) and len(few) >= 3
        monkeypatch.undo()
    assert C.pattern_hits(seqs.limit(0), forms, 4).count() == 0


def test_ties_go_to_the_smaller_pattern(spark):
    seqs = spark.createDataFrame([("c", 0, i, "aacc") for i in range(20)] + [("c", 1, 100 + i, "gggg") for i in range(20)], "contrast string, set_id int, seq_id long, sequence string")
    found = search.find_multiple(seqs, [2], 1, search.Objective("mi"), search.Options(max_degeneracy=0))
    assert found[0].motif == "aa"


def test_words_across_pieces(spark, monkeypatch):
    """Words of sequences that are numbered in pieces: none is lost or counted twice at their ends."""
    monkeypatch.setattr(C, "PIECE", 7)
    rng = random.Random(11)
    seqs = ["".join(rng.choice("acgtn") for _ in range(rng.randrange(60))) for _ in range(30)] + ["", "é" * 9 + "acgtacg"]
    for both in (False, True):
        for each in (False, True):
            row, code, n = C.word_codes(seqs, 3, both, each)
            got = {(int(i), int(c)): int(x) for i, c, x in zip(row, code, n)}
            want = Counter()
            for i, s in enumerate(seqs):
                for at in range(len(s) - 2):
                    w = s[at : at + 3]
                    if set(w) <= set("acgt"):
                        w = min(w, "".join("tgca"["acgt".index(x)] for x in reversed(w))) if both else w
                        want[i, int("".join(str("acgt".index(x)) for x in w), 4)] += 1
            assert got == (dict(want) if each else {k: 1 for k in want})
