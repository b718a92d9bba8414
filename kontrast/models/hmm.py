"""Hidden Markov models of patterns in a background: construction, and kernels over batches of sequences.

State 0 is the background; a sequence starts as if it came from there. Kernels take many sequences at a time and step
through positions together, so each step is one matrix product. Bases that aren't acgt are emitted with 1/4 by all.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np

from ..functions.alphabet import IUPAC

ORDER = "acgt"
_CODES = np.full(256, 4, np.int8)
for _i, _b in enumerate(ORDER):
    _CODES[[ord(_b), ord(_b.upper())]] = _i
_CODES[[ord("u"), ord("U")]] = 3


@dataclass
class Group:
    kind: str  # background or motif
    name: str
    states: list[int]


def emission_of(letter: str, alpha: float = 0.03) -> list[float]:
    """Bases that the letter allows share what the others leave; each of those has ``alpha``."""
    inside = IUPAC[letter]
    rest = (1 - alpha * (4 - len(inside))) / len(inside)
    return [rest if b in inside else alpha for b in ORDER] if len(inside) < 4 else [0.25] * 4


def entry_share(expected_length: float, width: int, sites: float = 1.0) -> float:
    """Chance to begin a site at a position so that a sequence has ``sites`` of them."""
    return min(0.5, sites / max(1.0, expected_length - width + 1))


@dataclass
class Hmm:
    transition: np.ndarray = field(default_factory=lambda: np.ones((1, 1)))
    emission: np.ndarray = field(default_factory=lambda: np.full((1, 4), 0.25))
    groups: list[Group] = field(default_factory=lambda: [Group("background", "background", [0])])

    def copy(self) -> Hmm:
        return Hmm(self.transition.copy(), self.emission.copy(), [Group(g.kind, g.name, list(g.states)) for g in self.groups])

    @property
    def motifs(self) -> list[Group]:
        return [g for g in self.groups if g.kind == "motif"]

    def add_motif(self, motif: str | np.ndarray, name: str, expected_length: float, sites: float = 1.0, alpha: float = 0.03, insertions: tuple[int, ...] = (), pad_left: int = 0, pad_right: int = 0) -> Hmm:
        """A chain of states for each place, entered from the background and left to it.

        ``insertions`` are places after which one optional state of any base may follow.
        """
        rows = [emission_of(x, alpha) for x in "n" * pad_left + motif + "n" * pad_right] if isinstance(motif, str) else [list(r) for r in motif]
        out, first, w = self.copy(), len(self.transition), len(rows)
        n = first + w + len(insertions)
        t = np.zeros((n, n))
        t[:first, :first] = out.transition
        share = entry_share(expected_length, w, sites)
        t[0] *= 1 - share
        t[0, first] = share
        for k in range(w):
            t[first + k, first + k + 1 if k + 1 < w else 0] = 1.0
        emissions = rows + [[0.25] * 4] * len(insertions)
        for extra, at in enumerate(insertions):
            k, state = first + pad_left + at - 1, first + w + extra
            t[k, k + 1], t[k, state], t[state, k + 1] = 0.5, 0.5, 1.0
        out.transition, out.emission = t, np.vstack([out.emission, emissions])
        out.groups.append(Group("motif", name, list(range(first, n))))
        return out

    def append(self, other: Hmm, sites_share: float | None = None) -> Hmm:
        """The motifs of another model as well."""
        out = self
        for g in other.motifs:
            s = np.array(g.states)
            base = out.copy()
            first = len(base.transition)
            n = first + len(s)
            t = np.zeros((n, n))
            t[:first, :first] = base.transition
            t[first:, first:] = other.transition[np.ix_(s, s)]
            t[first:, 0] += 1 - t[first:].sum(1)
            enter = other.transition[0, s] if sites_share is None else other.transition[0, s] / other.transition[0, s].sum() * sites_share
            t[0] *= 1 - enter.sum()
            t[0, first:] = enter
            base.transition, base.emission = t, np.vstack([base.emission, other.emission[s]])
            base.groups.append(Group("motif", g.name, list(range(first, n))))
            out = base
        return out

    def reverse_twin(self) -> Hmm:
        """The model that reads the other strand: motif chains reversed, with complementary bases."""
        out = self.copy()
        for g in out.motifs:
            s = np.array(g.states)
            inner = self.transition[np.ix_(s, s)]
            flow = inner.copy()
            back = flow.T / np.maximum(flow.T.sum(1, keepdims=True), 1e-300)
            starts, ends = self.transition[0, s], np.maximum(0, 1 - inner.sum(1))
            out.transition[np.ix_(s, s)] = back * (1 - (starts > 0)[:, None])
            out.transition[s, 0] = 1 - out.transition[np.ix_(s, s)].sum(1)
            out.transition[0, s] = ends / ends.sum() * starts.sum()
            out.emission[s] = self.emission[s][:, ::-1]
        return out

    def without(self, names: set[str] | None = None) -> np.ndarray:
        """Numbers of the states that stay if the named motifs (all by default) may not be visited."""
        gone = {s for g in self.motifs if names is None or g.name in names for s in g.states}
        return np.array([s for s in range(len(self.transition)) if s not in gone])

    def consensus(self, name: str, threshold: float = 0.1) -> str:
        letter = {frozenset(b): x for x, b in IUPAC.items()}
        g = next(g for g in self.motifs if g.name == name)
        return "".join(letter[frozenset(b for b, p in zip(ORDER, self.emission[s], strict=True) if p >= threshold) or frozenset(ORDER)] for s in g.states)

    def information(self, name: str) -> float:
        g = next(g for g in self.motifs if g.name == name)
        e = np.maximum(self.emission[g.states], 1e-300)
        return float((2 + (e * np.log2(e)).sum(1)).sum())

    def order(self) -> list[int]:
        """States so that each comes after those from which alone it can be reached, by what can reach it; ties by number."""
        reach = self.transition > 0
        for k in range(len(reach)):
            reach = reach | (reach[:, k : k + 1] & reach[k : k + 1])
        one_way = reach & ~reach.T
        return sorted(range(len(reach)), key=lambda s: (int(one_way[:, s].sum()), s))

    def edges(self) -> list[tuple[int, int, float]]:
        return [(int(i), int(j), float(self.transition[i, j])) for i, j in zip(*np.nonzero(self.transition), strict=True)]

    def to_json(self) -> str:
        return json.dumps({"version": 1, "transition": self.transition.tolist(), "emission": self.emission.tolist(), "groups": [[g.kind, g.name, g.states] for g in self.groups]})

    @classmethod
    def from_json(cls, text: str) -> Hmm:
        x = json.loads(text)
        if x.get("version") != 1:
            raise ValueError("unknown version of model parameters")
        return cls(np.array(x["transition"]), np.array(x["emission"]), [Group(*g) for g in x["groups"]])


# --- kernels ---


def encode(seqs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes padded with 4, lengths)."""
    lengths = np.array([len(s) for s in seqs], np.int64)
    out = np.full((len(seqs), int(lengths.max()) if len(seqs) else 0), 4, np.int8)
    for i, s in enumerate(seqs):
        out[i, : len(s)] = _CODES[np.frombuffer(s.encode("ascii", "replace"), np.uint8)]
    return out, lengths


def _emit(e: np.ndarray) -> np.ndarray:
    return np.hstack([e, np.full((len(e), 1), 0.25)])


def forward(t: np.ndarray, e: np.ndarray, codes: np.ndarray, lengths: np.ndarray, keep: bool = False):
    """Log-likelihoods, and with ``keep`` scaled forward values (position, sequence, state) and scales.

    ``t`` may be part of a model: rows then sum to less than 1 and the result is the chance of staying inside.
    """
    n, width = codes.shape
    emit = _emit(e)
    a, log = np.zeros((n, len(t))), np.zeros(n)
    alphas, scales = (np.zeros((width, n, len(t))), np.ones((width, n))) if keep else (None, None)
    for p in range(width):
        on = p < lengths
        nxt = (a @ t if p else np.broadcast_to(t[0], a.shape)) * emit[:, codes[:, p]].T
        c = nxt.sum(1)
        c[~on] = 1.0
        c = np.maximum(c, 1e-300)
        a = np.where(on[:, None], nxt / c[:, None], a)
        log += np.where(on, np.log(c), 0.0)
        if keep:
            alphas[p], scales[p] = a, c
    return (log, alphas, scales) if keep else log


def expected_counts(t: np.ndarray, e: np.ndarray, codes: np.ndarray, lengths: np.ndarray, weights: np.ndarray | None = None):
    """(log-likelihoods, transition counts, emission counts), summed over sequences by weight."""
    log, alphas, scales = forward(t, e, codes, lengths, True)
    n, width = codes.shape
    w = np.ones(n) if weights is None else weights
    emit = _emit(e)
    beta = np.ones((n, len(t)))
    ct, ce = np.zeros_like(t), np.zeros((len(t), 5))
    for p in range(width - 1, -1, -1):
        on = p < lengths
        post = np.where(on[:, None], alphas[p] * beta * w[:, None], 0.0)
        np.add.at(ce.T, codes[:, p], post)
        ahead = emit[:, codes[:, p]].T * beta / scales[p][:, None]
        before = alphas[p - 1] if p else None
        live = np.where(on[:, None], ahead * w[:, None], 0.0)
        if p:
            ct += t * (before.T @ live)
        else:
            ct[0] += t[0] * live.sum(0)
        beta = np.where(on[:, None], ahead @ t.T, beta)
    return log, ct, ce[:, :4]


def expected_entries(t: np.ndarray, e: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(sequence, state): how often the background is expected to be left for each state."""
    _, alphas, scales = forward(t, e, codes, lengths, True)
    n, width = codes.shape
    emit = _emit(e)
    beta, out = np.ones((n, len(t))), np.zeros((n, len(t)))
    for p in range(width - 1, -1, -1):
        on = (p < lengths)[:, None]
        ahead = emit[:, codes[:, p]].T * beta / scales[p][:, None]
        here = alphas[p - 1][:, :1] if p else np.ones((n, 1))
        out += np.where(on, here * t[0] * ahead, 0.0)
        beta = np.where(on, ahead @ t.T, beta)
    return out


def entry_posteriors(t: np.ndarray, e: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(position, sequence, state): the chance that the background is left for each state at each position."""
    _, alphas, scales = forward(t, e, codes, lengths, True)
    n, width = codes.shape
    emit = _emit(e)
    beta, out = np.ones((n, len(t))), np.zeros((width, n, len(t)))
    for p in range(width - 1, -1, -1):
        on = (p < lengths)[:, None]
        ahead = emit[:, codes[:, p]].T * beta / scales[p][:, None]
        here = alphas[p - 1][:, :1] if p else np.ones((n, 1))
        out[p] = np.where(on, here * t[0] * ahead, 0.0)
        beta = np.where(on, ahead @ t.T, beta)
    return out


def viterbi(t: np.ndarray, e: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    with np.errstate(divide="ignore"):
        lt, le = np.log(t), np.log(_emit(e))
    n, width = codes.shape
    best = np.zeros((n, len(t)))
    back = np.zeros((width, n, len(t)), np.int16)
    for p in range(width):
        on = (p < lengths)[:, None]
        come = best[:, :, None] + lt[None] if p else np.broadcast_to(lt[0][None, None], (n, 1, len(t)))
        nxt = come.max(1) + le[:, codes[:, p]].T
        back[p] = np.where(on, come.argmax(1), np.arange(len(t)))
        best = np.where(on, nxt, best)
    at = best.argmax(1)
    score, paths = best.max(1), np.zeros((n, width), np.int16)
    for p in range(width - 1, -1, -1):
        paths[:, p] = at
        at = back[p][np.arange(n), at]
    return score, [paths[i, :m] for i, m in enumerate(lengths)]
