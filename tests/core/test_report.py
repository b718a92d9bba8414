import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kontrast.models.hmm import Hmm, encode, entry_posteriors, expected_entries
from kontrast.models.training import class_posterior, disjoint, posterior_lines, reestimated_priors
from kontrast.operators import report as R
from kontrast.operators import search
from kontrast.operators.counting import occurrence_table
from kontrast.operators.sampler import find_model_mcmc
from kontrast.plans.analysis import Plan, evaluate, plan_from
from kontrast.sources import specs

from .test_core import make


def test_report_bed_and_marks(spark):
    seqs = make(spark, [["acgtacgt", "ttacgta", ""], ["gggg", "acg", "tttt"]])
    r = R.seed_report(seqs, ["acg", "nng"]).where("motif = 'acg'").first()
    assert (r.regex, r.length, r.ic, r.degeneracy) == ("acg", 3, 6.0, 0)
    assert [(c.set_id, c.with_motif, c["all"]) for c in r.counts] == [(0, 2, 3), (1, 1, 3)]
    swapped = R.seed_report(seqs, ["acg"], signals={"c": [1]}).first()
    assert swapped.dfreq == -r.dfreq and [c.set_id for c in swapped.counts] == [1, 0]
    lines = sorted(tuple(x) for x in R.bed(occurrence_table(seqs, {"m": "acg"})).where("seq_id = 0").collect())
    assert lines == [(0, 0, 3, "site_0", 0, "+"), (0, 4, 7, "site_1", 0, "+")]
    marks = {x.seq_id: x.marks for x in R.annotated(seqs, ["acg", "cgt"]).collect()}
    assert marks[0] == "ABBBABBB" and marks[1] == "..ABBB." and marks[2] == "" and marks[1002] == "...."
    assert R.matrix_of("an") == [(0, 1.0, 0.0, 0.0, 0.0), (1, 0.25, 0.25, 0.25, 0.25)]
    x = spark.range(1).select(R.shifted_positions(F.array(F.lit(0), F.lit(2), F.lit(9)), 1, F.lit(10)).alias("x")).first().x
    assert x == [1, 3]


def test_signal_sets_by_name(spark):
    seqs = make(spark, [["cccc"] * 20, ["acgt"] * 20])
    opt = search.Options(max_degeneracy=0, candidates=5)
    found = search.find_seeds(seqs, 3, search.Objective("mi", signals={"c": [1]}), opt).first()
    assert found.motif in ("acg", "cgt")
    assert search.find_seeds(seqs, 3, search.Objective("mi"), opt).first().motif == "ccc"
    _, sets, _ = specs.harmonised([specs.parse_motif("m:acg")], [specs.parse_dataset("control:c:a.fa"), specs.parse_dataset("m:c:b.fa")], [])
    assert R.signals_of(sets, "m") == {"c": [1]}


def test_posteriors_order_and_tasks(spark):
    model = Hmm().add_motif("acg", "m", 20)
    codes, lengths = encode(["ttacgtt", "acgacg", "c"])
    post = entry_posteriors(model.transition, model.emission, codes, lengths)
    assert np.allclose(post.sum(0), expected_entries(model.transition, model.emission, codes, lengths))
    lines = posterior_lines(make(spark, [["ttacgtt", "", "c"]]), model).orderBy("seq_id", "pos").collect()
    assert len(lines) == 8 and max(lines, key=lambda r: r.p_m).pos == 2
    assert np.allclose([r.p_m for r in lines[:7]], post[:7, 0, 1])
    chain = Hmm(np.array([[0.5, 0.5, 0.0], [0.0, 0.5, 0.5], [0.0, 0.0, 1.0]]), np.full((3, 4), 0.25))
    assert chain.order() == [0, 1, 2]
    disjoint([("a", [1, 2]), ("b", [3])])
    with pytest.raises(ValueError, match="state 2"):
        disjoint([("a", [1, 2]), ("b", [2])])


def test_strands_of_model_sites(spark):
    """Sites on the reverse complement are reported on the forward strand."""
    rng = random.Random(3)
    rows = []
    for i in range(20):
        s = "".join(rng.choice("at") for _ in range(30))
        rows.append(s[:10] + ("ccgcgg"[:3] + "acc" if i % 2 else "ggtcgg") + s[16:])
    model = Hmm().add_motif("ccgacc", "m", 60, alpha=0.001)
    occ = evaluate(make(spark, [rows]), model, both_strands=True)["occurrences"].collect()
    minus = [(r.seq_id, r.forwardpos) for r in occ if r.strand == "-"]
    assert sorted(minus) == [(i, 10) for i in range(0, 20, 2)]


def test_priors_plans_and_model_sampler(spark, tmp_path):
    rng = random.Random(5)
    rich = ["".join(rng.choice("cccg") for _ in range(20)) for _ in range(30)]
    poor = ["".join(rng.choice("aaat") for _ in range(20)) for _ in range(10)]
    a, b = Hmm(), Hmm()
    a.emission[0], b.emission[0] = [0.05, 0.6, 0.3, 0.05], [0.6, 0.05, 0.05, 0.3]
    seqs = make(spark, [rich + poor])
    priors = reestimated_priors(seqs, {"rich": a, "poor": b}, {"rich": 0.5, "poor": 0.5})["c"]
    assert abs(priors["rich"] - 31 / 42) < 1e-3 and abs(sum(priors.values()) - 1) < 1e-12
    assert class_posterior(seqs, {"rich": a, "poor": b}, priors).where("p_rich > 0.5").count() == 30
    (tmp_path / "plan.toml").write_text('lengths = [5, 6]\nmeasure = "mcc"\npadding = [1, 2]\n[search]\ncandidates = 7\n')
    plan = plan_from(str(tmp_path / "plan.toml"), measure="mi")
    assert isinstance(plan, Plan) and (plan.lengths, plan.measure, plan.padding, plan.search.candidates) == ([5, 6], "mi", (1, 2), 7)
    with pytest.raises(ValueError, match="colour"):
        plan_from(str(tmp_path / "plan.toml"), colour=1)
    planted = make(spark, [["tt" + "acgt" + "tata"] * 10, ["ttttatata"] * 10])
    start = Hmm().add_motif("acgt", "m", 9)
    found = find_model_mcmc(planted, start, chains=2, steps=2)
    assert found[0][0] >= found[-1][0] and len(found) >= 2
    assert all(np.allclose(m.transition.sum(1), 1) and np.allclose(m.emission.sum(1), 1) for _, m in found)
