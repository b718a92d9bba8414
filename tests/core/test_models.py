import itertools
import math
import random

import numpy as np
import pytest

from kontrast.models import training as T
from kontrast.models.hmm import Hmm, emission_of, encode, entry_share, expected_counts, expected_entries, forward, viterbi
from kontrast.operators.sampler import find_mcmc, moved, parallel_tempering
from kontrast.operators.search import Objective, Options
from kontrast.plans.analysis import Plan, analyse, shifts
from tests.core.test_core import make


def planted(spark, n=24, size=30, motif="tgtaa", seed=4):
    rng = random.Random(seed)
    back = lambda k: "".join(rng.choice("acgt") for _ in range(k))
    signal = []
    for _ in range(n):
        k = rng.randrange(size - len(motif))
        signal.append(back(k) + motif + back(size - len(motif) - k))
    return make(spark, [signal, [back(size) for _ in range(n)]])


def small():
    return Hmm().add_motif("ac", "m", 6, 1.0, insertions=(1,))


def test_construction():
    assert [round(max(emission_of(x)), 6) for x in "armn"[:1] + "rvn"] == [0.91, 0.47, 0.323333, 0.25]
    assert entry_share(50, 8) == pytest.approx(0.023255813953488372)
    m = small()
    assert np.allclose(m.transition.sum(1), 1) and np.allclose(m.emission.sum(1), 1)
    assert m.consensus("m").startswith("ac") and Hmm.from_json(m.to_json()).edges() == m.edges()
    twin = Hmm().add_motif("acc", "m", 6).reverse_twin()
    assert twin.consensus("m") == "tgg" and np.allclose(twin.transition.sum(1), 1)
    both = Hmm().add_motif("ac", "x", 9).append(Hmm().add_motif("gtt", "y", 9))
    assert np.allclose(both.transition.sum(1), 1) and [g.name for g in both.motifs] == ["x", "y"]


def test_kernels_equal_enumeration_of_paths():
    m = small()
    n = len(m.transition)
    e = np.hstack([m.emission, np.full((n, 1), 0.25)])
    seqs = ["acgtn", "ac", "ttacg"]
    codes, lengths = encode(seqs)
    log, ct, ce = expected_counts(m.transition, m.emission, codes, lengths)
    best, paths = viterbi(m.transition, m.emission, codes, lengths)
    want_t = np.zeros((n, n))
    for i, k in enumerate(lengths):
        total, top = 0.0, (-1.0, None)
        joint = []
        for path in itertools.product(range(n), repeat=int(k)):
            p, at = 1.0, 0
            for x, s in zip(codes[i], path):
                p *= m.transition[at, s] * e[s, x]
                at = s
            if p:
                joint.append((p, path))
                total += p
                top = max(top, (p, path))
        assert log[i] == pytest.approx(math.log(total)) and best[i] == pytest.approx(math.log(top[0]))
        for p, path in joint:
            for a, b in zip((0, *path[:-1]), path):
                want_t[a, b] += p / total
    assert np.allclose(expected_entries(m.transition, m.emission, codes, lengths).sum(0), want_t[0])
    assert np.allclose(ct, want_t) and ce.sum() == pytest.approx(11)
    assert len(paths[1]) == 2 and np.allclose(forward(m.transition, m.emission, codes, lengths), log)


def test_likelihood_rises_and_sites_are_found(spark):
    s = planted(spark)
    model = Hmm().add_motif("tgtan", "m", 30)
    trained, history = T.train_em(s.where("set_id = 0"), model, 8, 0.0, pseudo_emission=0.0)
    assert all(b >= a - 1e-9 for a, b in zip(history, history[1:]))
    hard, _ = T.train_em(s, model, 3, hard=True)
    assert np.allclose(hard.transition.sum(1), 1)
    scores = T.score(s, model).toPandas()
    p = scores.groupby("set_id").p_site.mean()
    assert p[0] > p[1] and scores.sites.between(0, 30).all() and (scores.p_m - scores.p_site).abs().max() < 1e-9
    d = T.decode(s, Hmm().add_motif("tgtaa", "m", 30, 1.0, 0.001))
    hits = d.where("set_id = 0").toPandas()
    assert (hits.n_sites >= 1).mean() > 0.9
    assert T.path_mask(d).count() >= 5 * hits.n_sites.sum()
    assert T.score(s.limit(0), model).count() == 0
    c = T.class_posterior(s, {"with": model, "none": Hmm()}, {"with": 0.5, "none": 0.5}).toPandas()
    assert np.allclose(c.p_with + c.p_none, 1)


@pytest.mark.parametrize("measure", ["mi", "mcc", "dfreq", "dlogl"])
def test_gradient_equals_differences(spark, measure):
    s = planted(spark, 6, 12).coalesce(1).persist()
    m = Hmm().add_motif("tgn", "m", 12, 1.0, 0.1)
    value, gt, ge = T.objective(s, m, measure)
    rng = np.random.default_rng(1)
    dt, de = rng.standard_normal(gt.shape), rng.standard_normal(ge.shape)
    h = 1e-5
    up, down = (T.objective(s, T.stepped(m, dt, de, x, T.Targets()), measure, gradient=False)[0] for x in (h, -h))
    assert (up - down) / (2 * h) == pytest.approx(float((gt * dt).sum() + (ge * de).sum()), rel=1e-4, abs=1e-7)
    with pytest.raises(ValueError):
        T.objective(s, m, "chisq")


def test_training_raises_the_measure_and_analysis_runs(spark):
    s = planted(spark)
    start = Hmm().add_motif("tgtnn", "m", 30)
    before = T.objective(s, start, "mi")[0]
    model, history = T.train_gradient(s, start, "mi", 2)
    assert history[-1] > before and T.objective(s, model, "mi")[0] == pytest.approx(history[-1])
    for mode in ("fr", "pr", "hs", "dy", "none"):
        g = np.array([1.0, 2.0])
        assert T.direction(mode, g, np.array([2.0, 1.0]), np.array([2.0, 1.0])) @ g > 0
    x, v = T.line_search(lambda t: (-((t - 3) ** 2), -2 * (t - 3)), -9.0, 6.0)
    assert v >= -1 and x > 0
    assert shifts("acg", 1) == ["cgn", "acg", "nac"]
    model, value, out = analyse(s, Plan(seeds=["tgtaa"], iterations=1))
    assert value > 0.1 and out["occurrences"].count() > 0 and out["ranks"].count() == 2
    with pytest.raises(ValueError):
        analyse(s, Plan(seeds=["x1"]))


def test_sampler(spark):
    rng = random.Random(1)
    assert all(len(moved("acgt", rng)) == 4 for _ in range(50))
    best = parallel_tempering([0, 5], [1.0, 0.5], 200, lambda x, r: x + r.choice([-1, 1]), lambda xs: [-abs(x - 20) / 5 for x in xs])
    assert best[0][1] == 20
    s = planted(spark, 20, 15, "tg" * 3)
    found = find_mcmc(s, 3, Objective("mi"), Options(), chains=2, steps=4)
    assert found == sorted(found, key=lambda x: (-x[0], repr(x[1]))) and len({m for _, m in found}) == len(found)


def test_stream(spark, tmp_path):
    from kontrast.streaming.fasta import fasta_stream, reverse_strand, shuffled_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text(">x 1\nACGU\nac\n>y\nTT\n")
    out = []
    for f in (lambda r: r, reverse_strand, shuffled_stream):
        q = f(fasta_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName(f"q{len(out)}").start()
        q.processAllAvailable()
        q.stop()
        out.append({r.definition: r.sequence for r in spark.table(f"q{len(out)}").collect()})
    assert out[0] == {"x 1": "acgtac", "y": "tt"} and out[1]["x 1"] == "gtacgt" and sorted(out[2]["x 1"]) == sorted("acgtac")
