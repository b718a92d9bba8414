"""Models over sets of sequences: scoring, decoding, and training by expectation or by gradient.

Each pass over the data is one job: tasks run the kernels over batches and return sums, which are added before they
reach the driver; what reaches it has the size of the model times the number of sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hmm import Hmm, encode, entry_posteriors, expected_counts, expected_entries, forward, viterbi

#: Cells (sequences times positions times states) of one call of a kernel.
CELLS = 4_000_000


def batches(seqs: list[str], states: int) -> Iterator[np.ndarray]:
    """Indices of sequences of like length that fit into CELLS; sequences without bases are left out."""
    order = np.argsort([len(s) for s in seqs], kind="stable")
    part: list[int] = []
    for i in order:
        if not seqs[i]:
            continue
        if part and (len(part) + 1) * len(seqs[i]) * states > CELLS:
            yield np.array(part)
            part = []
        part.append(int(i))
    if part:
        yield np.array(part)


def score(seqs: DataFrame, model: Hmm) -> DataFrame:
    """(contrast, set_id, seq_id, log_p, p_site, sites) and for each motif (by ``motifs``) its p_site and expected sites.

    p_site is 1 - exp(log-likelihood without the motif's states - log-likelihood).
    """
    names = [g.name for g in model.motifs]
    starts = [[s for s in g.states if model.transition[0, s] > 0] for g in model.motifs]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            q = b["sequence"].tolist()
            log, p, m, each = np.zeros(len(q)), np.zeros(len(q)), np.zeros((len(q), len(names))), np.zeros((len(q), len(names)))
            for ix in batches(q, len(model.transition)):
                codes, lengths = encode([q[i] for i in ix])
                log[ix] = forward(model.transition, model.emission, codes, lengths)
                keep = model.without()
                p[ix] = -np.expm1(np.minimum(0, forward(model.transition[np.ix_(keep, keep)], model.emission[keep], codes, lengths) - log[ix]))
                for k, g in enumerate(names):
                    keep = model.without({g})
                    m[ix, k] = -np.expm1(np.minimum(0, forward(model.transition[np.ix_(keep, keep)], model.emission[keep], codes, lengths) - log[ix]))
                entries = expected_entries(model.transition, model.emission, codes, lengths)
                each[ix] = np.stack([entries[:, s].sum(1) for s in starts], 1) if starts else np.zeros((len(ix), 0))
            yield b[["contrast", "set_id", "seq_id"]].assign(log_p=log, p_site=p, sites=each.sum(1), motif_p=list(m), motif_sites=list(each))

    out = seqs.select("contrast", "set_id", "seq_id", "sequence").mapInPandas(run, "contrast string, set_id int, seq_id long, log_p double, p_site double, sites double, motif_p array<double>, motif_sites array<double>")
    for k, name in enumerate(names):
        out = out.withColumn(f"p_{name}", F.col("motif_p")[k]).withColumn(f"sites_{name}", F.col("motif_sites")[k])
    return out.drop("motif_p", "motif_sites")


def decode(seqs: DataFrame, model: Hmm) -> DataFrame:
    """(contrast, set_id, seq_id, log_p, n_sites, path, sites array<struct<motif, pos, end>>): the most likely paths.

    The path has a character for each position: - for the background, and the motif's number.
    """
    kind = np.full(len(model.transition), -1)
    first = np.zeros(len(model.transition), bool)
    for k, g in enumerate(model.motifs):
        kind[g.states] = k
        for s in g.states:
            first[s] = model.transition[0, s] > 0
    letters = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            q = b["sequence"].tolist()
            log, text, sites = [0.0] * len(q), [""] * len(q), [[] for _ in q]
            for ix in batches(q, len(model.transition) ** 2):
                codes, lengths = encode([q[i] for i in ix])
                best, paths = viterbi(model.transition, model.emission, codes, lengths)
                for i, s, path in zip(ix, best, paths, strict=True):
                    ks = kind[path]
                    log[i], text[i] = float(s), "".join("-" if k < 0 else letters[k % len(letters)] for k in ks)
                    begins = np.flatnonzero(first[path] & (np.append(True, (ks[1:] != ks[:-1]) | first[path][1:])))
                    for a in begins:
                        end = a + 1
                        while end < len(ks) and ks[end] == ks[a] and not first[path[end]]:
                            end += 1
                        sites[i].append({"motif": model.motifs[ks[a]].name, "pos": int(a), "end": int(end)})
            yield b[["contrast", "set_id", "seq_id"]].assign(log_p=log, n_sites=[len(x) for x in sites], path=text, sites=sites)

    return seqs.select("contrast", "set_id", "seq_id", "sequence").mapInPandas(run, "contrast string, set_id int, seq_id long, log_p double, n_sites long, path string, sites array<struct<motif: string, pos: int, end: int>>")


def posterior_lines(seqs: DataFrame, model: Hmm) -> DataFrame:
    """(contrast, set_id, seq_id, pos, p_<motif> ..): the chance that a site of each motif begins at each position."""
    starts = [[s for s in g.states if model.transition[0, s] > 0] for g in model.motifs]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            q = b["sequence"].tolist()
            lines: list[list] = [[] for _ in q]
            for ix in batches(q, len(model.transition)):
                codes, lengths = encode([q[i] for i in ix])
                post = entry_posteriors(model.transition, model.emission, codes, lengths)
                each = np.stack([post[:, :, s].sum(2) for s in starts], 2) if starts else np.zeros((*post.shape[:2], 0))
                for k, i in enumerate(ix):
                    lines[i] = each[: lengths[k], k].tolist()
            yield b[["contrast", "set_id", "seq_id"]].assign(lines=lines)

    rows = seqs.select("contrast", "set_id", "seq_id", "sequence").mapInPandas(run, "contrast string, set_id int, seq_id long, lines array<array<double>>")
    rows = rows.select("contrast", "set_id", "seq_id", F.posexplode("lines").alias("pos", "line"))
    return rows.select("contrast", "set_id", "seq_id", "pos", *[F.col("line")[k].alias(f"p_{g.name}") for k, g in enumerate(model.motifs)])


def path_mask(decoded: DataFrame) -> DataFrame:
    """(seq_id, pos): positions that the most likely paths give to motifs."""
    return decoded.select("seq_id", F.explode("sites").alias("s")).select("seq_id", F.explode(F.sequence(F.col("s.pos"), F.col("s.end") - 1)).alias("pos"))


def summed(seqs: DataFrame, kernel: Callable[[list[str]], dict[str, np.ndarray]], by_set: bool) -> dict[tuple[str, int], np.ndarray]:
    """Sums over sequences of one vector: by task, then over at most 32 parts, then on the driver; a vector for each set."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[str, int], np.ndarray] = {}
        for b in it:
            for key, g in b.groupby(["contrast", "set_id"]) if by_set else [(("", 0), b)]:
                v = kernel(g["sequence"].tolist())
                total[key] = total.get(key, 0) + v
        yield pd.DataFrame([(c, s, v.astype("<f8").tobytes()) for (c, s), v in total.items()], columns=["contrast", "set_id", "v"])

    def add(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"contrast": [g["contrast"].iloc[0]], "set_id": [g["set_id"].iloc[0]], "v": [sum(np.frombuffer(x, "<f8") for x in g["v"]).astype("<f8").tobytes()]})

    cells = "contrast string, set_id int, v binary"
    parts = seqs.select("contrast", "set_id", "sequence").mapInPandas(run, cells).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(32)))
    rows = parts.groupBy("contrast", "set_id", "part").applyInPandas(add, cells).collect()
    out: dict[tuple[str, int], np.ndarray] = {}
    for r in rows:
        k = (r["contrast"], r["set_id"])
        out[k] = out.get(k, 0) + np.frombuffer(r["v"], "<f8")
    return out


def log_likelihood(seqs: DataFrame, model: Hmm) -> float:
    def kernel(q: list[str]) -> np.ndarray:
        total = 0.0
        for ix in batches(q, len(model.transition)):
            total += forward(model.transition, model.emission, *encode([q[i] for i in ix])).sum()
        return np.array([total])

    return float(sum(v[0] for v in summed(seqs, kernel, False).values()))


def e_step(seqs: DataFrame, model: Hmm, hard: bool = False) -> tuple[float, np.ndarray, np.ndarray]:
    """(log-likelihood, transition counts, emission counts): expected ones, or with ``hard`` those of the best paths."""
    n = len(model.transition)

    def kernel(q: list[str]) -> np.ndarray:
        total = np.zeros(1 + n * n + 4 * n)
        for ix in batches(q, n * (n if hard else 1)):
            codes, lengths = encode([q[i] for i in ix])
            if hard:
                log, paths = viterbi(model.transition, model.emission, codes, lengths)
                ct, ce = np.zeros((n, n)), np.zeros((n, 5))
                for i, path in enumerate(paths):
                    np.add.at(ct, (np.append(0, path[:-1]), path), 1)
                    np.add.at(ce, (path, codes[i, : len(path)]), 1)
                ce = ce[:, :4]
            else:
                log, ct, ce = expected_counts(model.transition, model.emission, codes, lengths)
            total += np.concatenate([[log.sum()], ct.ravel(), ce.ravel()])
        return total

    v = sum(summed(seqs, kernel, False).values(), np.zeros(1 + n * n + 4 * n))
    return float(v[0]), v[1 : 1 + n * n].reshape(n, n), v[1 + n * n :].reshape(n, 4)


@dataclass
class Targets:
    """Which states' transitions and emissions may change; None: all."""

    transition: list[int] | None = None
    emission: list[int] | None = None


def normalised(counts: np.ndarray, old: np.ndarray, allowed: list[int] | None, pseudo: float) -> np.ndarray:
    out = old.copy()
    for s in range(len(old)) if allowed is None else allowed:
        row = np.where(old[s] > 0, counts[s] + pseudo, 0.0)
        if row.sum() > 0:
            out[s] = row / row.sum()
    return out


def train_em(seqs: DataFrame, model: Hmm, iterations: int = 100, tolerance: float = 1e-4, targets: Targets | None = None, pseudo_emission: float = 1.0, pseudo_transition: float = 0.0, hard: bool = False, skip_sets: tuple[int, ...] = ()) -> tuple[Hmm, list[float]]:
    """Re-estimation until the log-likelihood gains less than ``tolerance`` of itself. Sets to skip are left out."""
    targets = targets or Targets()
    data = (seqs.where(~F.col("set_id").isin(*skip_sets)) if skip_sets else seqs).select("contrast", "set_id", "sequence").persist()
    history: list[float] = []
    for _ in range(iterations):
        log, ct, ce = e_step(data, model, hard)
        history.append(log)
        if len(history) > 1 and log - history[-2] <= tolerance * abs(history[-2]):
            break
        model = model.copy()
        model.transition = normalised(ct, model.transition, targets.transition, pseudo_transition)
        model.emission = normalised(ce, model.emission, targets.emission, pseudo_emission)
    data.unpersist()
    return model, history


# --- discriminative training ---


def _mi(k: np.ndarray, n: np.ndarray, ps: float) -> float:
    a = np.stack([k + ps, n - k + ps], 1)
    p = a / a.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        x = p * np.log2(p / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True)))
    return float(np.nansum(x))


def _mcc(k: np.ndarray, n: np.ndarray, ps: float) -> float:
    a, b, c, d = k[0] + ps, n[0] - k[0] + ps, k[1:].sum() + ps, (n[1:] - k[1:]).sum() + ps
    z = (a + b) * (c + d) * (a + c) * (b + d)
    return float((a * d - b * c) / math.sqrt(z)) if z > 0 else 0.0


MEASURES: dict[str, Callable[[np.ndarray, np.ndarray, float], float]] = {
    "mi": _mi, "mcc": _mcc, "dfreq": lambda k, n, ps: float((k[0] + ps) / (n[0] + 2 * ps) - (k[1:].sum() + ps) / (n[1:].sum() + 2 * ps)),
}


def objective(seqs: DataFrame, model: Hmm, measure: str = "mi", ps: float = 1.0, gradient: bool = True) -> tuple[float, np.ndarray, np.ndarray]:
    """(score, gradient by log-odds of transitions, of emissions) of a measure of the expected counts of sequences with
    a site, summed over contrasts; or of ``dlogl``, the log-likelihood of set 0 less that of the others, or ``logl``.

    With rows p of a softmax, d log-likelihood / d parameter is count - p * sum of counts of the row; a sequence's site
    probability 1 - exp(L0 - L1) passes on exp(L0 - L1) times the difference of the gradients of L1 and L0.
    """
    if measure not in (*MEASURES, "dlogl", "logl"):
        raise ValueError(f"no gradient for {measure}")
    n, keep = len(model.transition), model.without()
    m = n * n + 4 * n
    direct = measure in ("dlogl", "logl")

    def chain(ct: np.ndarray, ce: np.ndarray) -> np.ndarray:
        return np.concatenate([(ct - model.transition * ct.sum(1, keepdims=True)).ravel(), (ce - model.emission * ce.sum(1, keepdims=True)).ravel()])

    def kernel(q: list[str]) -> np.ndarray:
        total = np.zeros(2 + m)
        for ix in batches(q, n):
            codes, lengths = encode([q[i] for i in ix])
            if direct:
                log, ct, ce = expected_counts(model.transition, model.emission, codes, lengths)
                total += np.concatenate([[log.sum(), len(ix)], chain(ct, ce)])
                continue
            l1 = forward(model.transition, model.emission, codes, lengths)
            sub, e0 = model.transition[np.ix_(keep, keep)], model.emission[keep]
            l0 = forward(sub, e0, codes, lengths)
            none = np.exp(np.minimum(0, l0 - l1))
            total[:2] += (1 - none).sum(), len(ix)
            if gradient:
                _, t1, e1 = expected_counts(model.transition, model.emission, codes, lengths, none)
                _, t0, c0 = expected_counts(sub, e0, codes, lengths, none)
                t1[np.ix_(keep, keep)] -= t0
                e1[keep] -= c0
                total[2:] += chain(t1, e1)
        return total

    sums = summed(seqs, kernel, True)
    score_, grad = 0.0, np.zeros(m)
    for c in sorted({c for c, _ in sums}):
        ids = sorted(s for x, s in sums if x == c)
        if direct:
            for s in ids:
                sign = 1 if measure == "logl" or s == 0 else -1
                score_ += sign * sums[c, s][0]
                grad += sign * sums[c, s][2:]
            continue
        if len(ids) < 2:
            raise ValueError(f"contrast {c} has one set; add a control")
        k, size = np.array([sums[c, s][0] for s in ids]), np.array([sums[c, s][1] for s in ids])
        f = MEASURES[measure]
        score_ += f(k, size, ps)
        for i, s in enumerate(ids):
            h = 1e-5 * max(1.0, size[i])
            up, down = k.copy(), k.copy()
            up[i] += h
            down[i] -= h
            grad += (f(up, size, ps) - f(down, size, ps)) / (2 * h) * sums[c, s][2:]
    return score_, grad[: n * n].reshape(n, n), grad[n * n :].reshape(n, 4)


def stepped(model: Hmm, dt: np.ndarray, de: np.ndarray, size: float, targets: Targets) -> Hmm:
    """The model after a step in log space, rows normalised again; transitions that are 0 stay 0."""
    out = model.copy()
    for old, d, new, allowed in ((model.transition, dt, out.transition, targets.transition), (model.emission, de, out.emission, targets.emission)):
        for s in range(len(old)) if allowed is None else allowed:
            with np.errstate(divide="ignore"):
                z = np.log(old[s]) + size * d[s]
            z -= z[np.isfinite(z)].max()
            new[s] = np.exp(z) / np.exp(z).sum()
    return out


def direction(mode: str, g: np.ndarray, g_old: np.ndarray | None, d_old: np.ndarray | None) -> np.ndarray:
    """Conjugate direction to climb: Fletcher-Reeves, Polak-Ribiere, Hestenes-Stiefel or Dai-Yuan; never downhill."""
    if mode == "none" or g_old is None or d_old is None:
        return g
    y = g - g_old
    top = {"fr": g @ g, "pr": g @ y, "hs": g @ y, "dy": g @ g}[mode]
    low = {"fr": g_old @ g_old, "pr": g_old @ g_old, "hs": -(d_old @ y), "dy": -(d_old @ y)}[mode]
    beta = max(0.0, top / low) if low else 0.0
    d = g + beta * d_old
    return d if d @ g > 0 else g


def line_search(f: Callable[[float], tuple[float, float]], value: float, slope: float, step: float = 1.0, mu: float = 0.1, eta: float = 0.5, trials: int = 9) -> tuple[float, float]:
    """(step, value) that increases enough (mu) where the slope has fallen (eta): widening, then cubic interpolation in
    the bracket. Each trial is one pass over the data for value and slope. The best step seen is returned if none fits."""
    lo, hi = (0.0, value, slope), None
    best = (0.0, value)
    x = step
    for _ in range(trials):
        v, s = f(x)
        if v > best[1]:
            best = (x, v)
        if v < value + mu * x * slope or v <= lo[1]:
            hi = (x, v, s)
        elif abs(s) <= eta * abs(slope):
            return x, v
        elif s > 0 and hi is None:
            lo = (x, v, s)
            x *= 4
            continue
        elif s > 0:
            lo = (x, v, s)
        else:
            hi = lo if hi is None else hi
            hi, lo = ((lo if s < 0 else hi), (x, v, s))
        if hi is None:
            x *= 4
            continue
        (a, fa, ga), (b, fb, gb) = lo, hi
        h = b - a
        d1 = ga + gb - 3 * (fa - fb) / (a - b) if h else 0.0
        r = d1 * d1 - ga * gb
        t = b - h * ((gb + math.sqrt(r) - d1) / (gb - ga + 2 * math.sqrt(r))) if r > 0 and gb - ga + 2 * math.sqrt(r) else a + h / 2
        x = t if min(a, b) + 0.1 * abs(h) < t < max(a, b) - 0.1 * abs(h) else a + h / 2
    return best


def train_gradient(seqs: DataFrame, model: Hmm, measure: str = "mi", iterations: int = 50, tolerance: float = 1e-4, mode: str = "pr", ps: float = 1.0, targets: Targets | None = None, hybrid: bool = True) -> tuple[Hmm, list[float]]:
    """Climbs a discriminative measure. Hybrid: motif emissions by its gradient, all else by expectation in between.

    The score is kept from falling: an expectation step that lowers it is undone.
    """
    motif_states = [s for g in model.motifs for s in g.states]
    targets = targets or (Targets([], motif_states) if hybrid else Targets())
    data = seqs.select("contrast", "set_id", "sequence").persist()
    history: list[float] = []
    g_old = d_old = None
    n = len(model.transition)
    value, gt, ge = objective(data, model, measure, ps)
    for _ in range(iterations):
        mask = np.concatenate([np.repeat(_flags(n, targets.transition), n), np.repeat(_flags(n, targets.emission), 4)])
        g = np.concatenate([gt.ravel(), ge.ravel()]) * mask
        history.append(value)
        norm = np.linalg.norm(g)
        if norm < 1e-10:
            break
        d = direction(mode, g, g_old, d_old)
        dt, de = d[: n * n].reshape(n, n), d[n * n :].reshape(n, 4)

        def at(x: float, dt=dt, de=de, d=d, mask=mask, model=model) -> tuple[float, float]:
            v, a, b = objective(data, stepped(model, dt, de, x, targets), measure, ps)
            return v, float((np.concatenate([a.ravel(), b.ravel()]) * mask) @ d)

        step, _ = line_search(at, value, float(g @ d), step=1.0 / max(norm, 1e-12))
        if step == 0:
            break
        model = stepped(model, dt, de, step, targets)
        if hybrid:
            _, ct, ce = e_step(data, model)
            rest = [s for s in range(n) if s not in motif_states]
            moved = model.copy()
            moved.transition, moved.emission = normalised(ct, model.transition, None, 0.0), normalised(ce, model.emission, rest, 1.0)
            new = objective(data, moved, measure, ps)
            if new[0] >= history[-1]:
                model = moved
            else:
                new = objective(data, model, measure, ps)
        else:
            new = objective(data, model, measure, ps)
        g_old, d_old = g, d
        gain, (value, gt, ge) = new[0] - value, new
        if gain <= tolerance * max(abs(value), 1e-12):
            break
    data.unpersist()
    return model, [*history, value]


def _flags(n: int, allowed: list[int] | None) -> np.ndarray:
    out = np.ones(n) if allowed is None else np.zeros(n)
    if allowed:
        out[allowed] = 1.0
    return out


def class_posterior(seqs: DataFrame, models: dict[str, Hmm], priors: dict[str, float], likelihoods: bool = False) -> DataFrame:
    """(contrast, set_id, seq_id, p_<class>): each class's share of prior times likelihood; or l_<class>, their logarithms."""
    out = None
    for name, model in models.items():
        s = score(seqs, model).select("contrast", "set_id", "seq_id", (F.col("log_p") + math.log(priors[name])).alias(f"l_{name}"))
        out = s if out is None else out.join(s, ["contrast", "set_id", "seq_id"])
    if likelihoods:
        return out
    top = F.greatest(*[F.col(f"l_{x}") for x in models]) if len(models) > 1 else F.col(f"l_{next(iter(models))}")
    z = sum((F.exp(F.col(f"l_{x}") - top) for x in models), F.lit(0.0))
    return out.select("contrast", "set_id", "seq_id", *[(F.exp(F.col(f"l_{x}") - top) / z).alias(f"p_{x}") for x in models])


def reestimated_priors(seqs: DataFrame, models: dict[str, Hmm], priors: dict[str, float], rounds: int = 10, tolerance: float = 1e-6) -> dict[str, dict[str, float]]:
    """{contrast: {class: prior}}: each contrast's class priors by expectation, from the classes' shares of its sequences.

    Likelihoods are worked out once; each round sums the shares, with 1 added for each class, by contrast.
    """
    scored = class_posterior(seqs, models, {c: 1.0 for c in models}, likelihoods=True).persist()
    now = {r["contrast"]: dict(priors) for r in scored.select("contrast").distinct().collect()}
    for _ in range(rounds):
        case = lambda c: F.coalesce(*[F.when(F.col("contrast") == k, F.lit(math.log(p[c]))) for k, p in now.items()])
        joint = {c: F.col(f"l_{c}") + case(c) for c in models}
        top = F.greatest(*joint.values()) if len(joint) > 1 else next(iter(joint.values()))
        z = sum((F.exp(v - top) for v in joint.values()), F.lit(0.0))
        if not now:
            break
        sums = scored.groupBy("contrast").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.exp(v - top) / z).alias(c) for c, v in joint.items()]).collect()
        new = {r["contrast"]: {c: (r[c] + 1) / (r["n"] + len(models)) for c in models} for r in sums}
        change = max(abs(new[k][c] - now[k][c]) for k in new for c in models)
        now = new
        if change < tolerance:
            break
    scored.unpersist()
    return now


def disjoint(tasks: list[tuple[str, list[int]]]) -> None:
    """Raises if two training tasks (name, states) share a state."""
    owner: dict[int, str] = {}
    for name, states in tasks:
        for s in states:
            if owner.setdefault(s, name) != name:
                raise ValueError(f"state {s} is trained by {owner[s]} and by {name}")
