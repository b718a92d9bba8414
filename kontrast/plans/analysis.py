"""The whole analysis: seeds, a model on each seed, training, selection of one or more patterns, evaluation."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions.alphabet import LETTERS
from ..models.hmm import Hmm
from ..models.training import decode, objective, score, train_em, train_gradient
from ..operators import association as S
from ..operators.counting import both_strand_sequence, set_sizes
from ..operators.sampling import split, with_control
from ..operators.search import Objective, Options, find_multiple


@dataclass
class Plan:
    lengths: list[int] = field(default_factory=lambda: [8])
    seeds: list[str] = field(default_factory=list)
    per_length: int = 1
    measure: str = "mi"
    wiggle: int = 0
    padding: tuple[int, int] = (0, 0)
    alpha: float = 0.03
    sites: float = 1.0
    iterations: int = 20
    mode: str = "pr"
    multiple: bool = False
    residual_ratio: float = 5.0
    p_value: float = 0.05
    train_share: float = 1.0
    salt: int = 1
    search: Options = field(default_factory=Options)


def shifts(word: str, n: int) -> list[str]:
    return list(dict.fromkeys("n" * max(0, s) + word[max(0, -s) : len(word) - max(0, s)] + "n" * max(0, -s) for s in range(-n, n + 1)))


def background(seqs: DataFrame) -> Hmm:
    """A model of one state with the bases' shares over all sequences."""
    n = seqs.agg(*[F.coalesce(F.sum(F.char_length("sequence") - F.char_length(F.translate("sequence", b, ""))), F.lit(0)).alias(b) for b in "acgt"]).first()
    m = Hmm()
    total = sum(n[b] + 1 for b in "acgt")
    m.emission[0] = [(n[b] + 1) / total for b in "acgt"]
    return m


def log_p(seqs: DataFrame, model: Hmm, ps: float = 1.0) -> float:
    """ln of the chance of the site counts' G statistic, corrected by ln 149 for each state of the motifs."""
    import numpy as np

    out = 0.0
    s = score(seqs, model).groupBy("contrast", "set_id").agg(F.sum("p_site").alias("k"), F.count(F.lit(1)).alias("n")).collect()
    for c in {r["contrast"] for r in s}:
        rows = [(r["k"] + ps, r["n"] + 2 * ps) for r in s if r["contrast"] == c]
        z, p = sum(n for _, n in rows), sum(k for k, _ in rows)
        g = 2 * sum(x * np.log(x * z / (n * col)) for k, n in rows for x, col in ((k, p), (n - k, z - p)) if x > 0)
        if len(rows) > 1:
            out += float(M.chi2_log_sf(np.array([g]), len(rows) - 1)[0])
    return out + M.FIXED_CORRECTION * sum(len(g.states) for g in model.motifs)


def plan_from(path: str, **overrides) -> Plan:
    """A plan from a TOML file of its fields, with a table ``search`` for the search; ``overrides`` win."""
    import tomllib
    from pathlib import Path

    told = tomllib.loads(Path(path).read_text()) | overrides
    names = {f.name for f in fields(Plan)}
    if unknown := set(told) - names:
        raise ValueError(f"no such option: {', '.join(sorted(unknown))}")
    if isinstance(told.get("search"), dict):
        told["search"] = Options(**told["search"])
    return Plan(**{k: tuple(v) if k == "padding" else v for k, v in told.items()})


def evaluate(seqs: DataFrame, model: Hmm, both_strands: bool = False) -> dict[str, DataFrame]:
    """Per sequence scores and paths, occurrences, tables by set, and ranks, as DataFrames.

    With both strands the model reads each sequence and its reverse complement; a site on the latter is reported with the
    strand - and where it stands on the forward strand.
    """
    forward = seqs
    seqs = both_strand_sequence(seqs) if both_strands else seqs
    s = score(seqs, model)
    paths = decode(seqs, model)
    motif = {g.name: "".join(model.consensus(g.name)) for g in model.motifs}
    named = F.element_at(F.create_map(*[F.lit(x) for kv in motif.items() for x in kv]), "motifname") if motif else F.lit("")
    size = forward.select("contrast", "set_id", "seq_id", F.char_length("sequence").alias("len"))
    occ = paths.select("contrast", "set_id", "seq_id", F.explode("sites").alias("x")).select("contrast", "set_id", "seq_id", "x.pos", "x.end", F.col("x.motif").alias("motifname"))
    occ = occ.join(size, ["contrast", "set_id", "seq_id"])
    back = F.col("pos") > F.col("len")  # after the separator: the other strand, read from its end
    place = F.when(back, 2 * F.col("len") + 1 - F.col("end")).otherwise(F.col("pos"))
    occ = occ.withColumns({"motif": named, "strand": F.when(back, "-").otherwise("+"), "forwardpos": place, "centerdist": place + (F.col("end") - F.col("pos")) / 2 - F.col("len") / 2}).drop("len")
    ranks = S.rank_information(s.join(seqs.select("contrast", "set_id", "seq_id", "rank"), ["contrast", "set_id", "seq_id"]), ["contrast", "set_id"], value="p_site")
    return {"scores": s, "paths": paths, "occurrences": occ, "bed": occ.select("seq_id", F.col("forwardpos").alias("pos"), (F.col("forwardpos") + F.col("end") - F.col("pos")).alias("end"), "motifname", F.lit(0).alias("score"), "strand"), "sets": s.groupBy("contrast", "set_id").agg(F.sum("p_site").alias("with_site"), F.sum("sites").alias("sites"), F.sum("log_p").alias("log_p")), "confusion": S.confusion(s, "p_site"), "ranks": ranks}


def analyse(seqs: DataFrame, plan: Plan) -> tuple[Hmm, float, dict[str, DataFrame]]:
    """(model, score on held-out data or all, evaluation).

    Each seed gives a model for each of its shifts, trained by the hybrid of gradient and expectation. One best model is
    kept; with ``multiple`` further patterns are added, best first, while they add ``residual_ratio`` times as much
    information about the sets, given the model so far, as they share with it, and their corrected p-value holds.
    """
    seqs = with_control(seqs, plan.salt).persist()
    parts = split(seqs, plan.train_share, plan.salt) if plan.train_share < 1 else seqs.withColumn("is_train", F.lit(True))
    learn = parts.where("is_train").drop("is_train")
    test = parts.where("NOT is_train").drop("is_train") if plan.train_share < 1 else seqs
    base = background(learn)
    words = list(plan.seeds) or [f.motif for f in find_multiple(learn, plan.lengths, plan.per_length, Objective("mi"), plan.search, each_length=True)]
    if bad := [w for w in words if set(w) - set(LETTERS)]:
        raise ValueError(f"no IUPAC pattern: {', '.join(bad)}")
    n = set_sizes(learn).agg(F.sum("seq_size"), F.sum("set_size")).first()
    length = n[0] / max(1, n[1])
    found: list[tuple[float, str, Hmm]] = []
    for k, w in enumerate(words):
        for v in shifts(w, plan.wiggle):
            start = base.add_motif(v, f"motif{k}", length, plan.sites, plan.alpha, pad_left=plan.padding[0], pad_right=plan.padding[1])
            model, history = train_gradient(learn, start, plan.measure, plan.iterations, mode=plan.mode)
            found.append((history[-1], v, model))
    if not found:
        model = base
        return model, 0.0, evaluate(test, model)
    found.sort(key=lambda x: (-x[0], x[1]))
    model = found[0][2]
    if plan.multiple:
        import math

        for k, (_, _, other) in enumerate(found[1:], 1):
            for g in other.motifs:
                g.name = f"extra{k}"
            a, b = score(learn, model), score(learn, other)
            both = a.select("contrast", "set_id", "seq_id", F.col("p_site").alias("old")).join(b.select("contrast", "set_id", "seq_id", F.col("p_site").alias("new")), ["contrast", "set_id", "seq_id"]).persist()
            more = sum(r["conditional_information"] for r in S.conditional_information(both, "contrast", "new", "old").collect())
            shared = sum(r["pair_information"] for r in S.pair_information(both, ["contrast"], "new", "old").collect())
            both.unpersist()
            if more >= plan.residual_ratio * shared and log_p(learn, other) <= math.log(plan.p_value):
                model, _ = train_em(learn, model.append(other), iterations=5)
    value = objective(test, model, plan.measure, gradient=False)[0]
    return model, value, evaluate(test, model)
