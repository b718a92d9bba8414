"""Monte Carlo search over patterns: Metropolis steps at several temperatures, scored together."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame

from ..functions.alphabet import CODE, LETTER, LETTERS
from .counting import motif_counts
from .search import Objective, Options, score_column, sizes_of, wide_counts

T = TypeVar("T")


def similar(letter: str, rng: random.Random) -> str:
    """A letter that allows one base more or less."""
    return rng.choice([LETTER[CODE[letter] ^ bit] for bit in (1, 2, 4, 8) if CODE[letter] ^ bit])


def moved(word: str, rng: random.Random) -> str:
    """A word with one letter changed a little or freely, or rolled by one place with a new letter at the free end."""
    kind, at = rng.random(), rng.randrange(len(word))
    if kind < 0.5:
        return word[:at] + similar(word[at], rng) + word[at + 1 :]
    if kind < 0.8:
        return word[:at] + rng.choice(LETTERS) + word[at + 1 :]
    new = rng.choice(LETTERS)
    return word[1:] + new if rng.random() < 0.5 else new + word[:-1]


def accepts(old: float, new: float, temperature: float, rng: random.Random) -> bool:
    """Metropolis rule for climbing with density exp(score / temperature)."""
    return new >= old or rng.random() < math.exp(max(-700.0, (new - old) / temperature))


def swaps(a: float, b: float, ta: float, tb: float, rng: random.Random) -> bool:
    """Whether neighbouring chains exchange their states."""
    x = (b - a) * (1 / ta - 1 / tb)
    return x >= 0 or rng.random() < math.exp(max(-700.0, x))


def parallel_tempering(starts: list[T], temperatures: list[float], steps: int, move: Callable[[T, random.Random], T], evaluate: Callable[[list[T]], list[float]], seed: int = 1) -> list[tuple[float, T]]:
    """The states of all chains in order of visit, best first. ``evaluate`` scores the proposals of all chains at once."""
    rng = random.Random(seed)
    state, score = list(starts), evaluate(starts)
    seen: dict = dict(zip(map(repr, state), zip(score, state), strict=True))
    for _ in range(steps):
        nxt = [move(s, rng) for s in state]
        new = evaluate(nxt)
        for i, (s, v) in enumerate(zip(nxt, new, strict=True)):
            seen.setdefault(repr(s), (v, s))
            if accepts(score[i], v, temperatures[i], rng):
                state[i], score[i] = s, v
        for i in range(len(state) - 1):
            if swaps(score[i], score[i + 1], temperatures[i], temperatures[i + 1], rng):
                state[i], state[i + 1], score[i], score[i + 1] = state[i + 1], state[i], score[i + 1], score[i]
    return sorted(seen.values(), key=lambda x: (-x[0], repr(x[1])))


def find_mcmc(seqs: DataFrame, length: int, objective: Objective, opt: Options, chains: int = 6, steps: int = 1000, temperature: float = 1e-3, seed: int = 1) -> list[tuple[float, str]]:
    """(score, pattern) visited, best first. Chain i runs at ``temperature`` halved i times. A step's proposals are
    counted in one job over all sequences; words scored before aren't counted again."""
    sizes = sizes_of(seqs, opt.per_occurrence, length)
    score = score_column(sizes, objective, opt.pseudo_count, opt.enriched_only)
    data = seqs.select("contrast", "set_id", "seq_id", "sequence").persist()
    known: dict[str, float] = {}

    def evaluate(words: list[str]) -> list[float]:
        if new := sorted(set(words) - set(known)):
            wide = wide_counts(motif_counts(data, new, opt.both_strands, opt.per_occurrence), sizes, "motif").withColumn("score", score)
            known.update({r["motif"]: r["score"] for r in wide.select("motif", "score").collect()})
        return [known[w] for w in words]

    rng = random.Random(seed)
    starts = ["".join(rng.choice(LETTERS) for _ in range(length)) for _ in range(chains)]
    out = parallel_tempering(starts, [temperature / 2**i for i in range(chains)], steps, moved, evaluate, seed)
    data.unpersist()
    return out


def model_moved(model, rng: random.Random):
    """A model with a motif's emissions changed at one place, its places rolled by one, or its rate of entry changed."""
    import numpy as np

    out = model.copy()
    g = rng.choice(out.motifs)
    kind = rng.random()
    if kind < 0.6:
        s = rng.choice(g.states)
        e = np.maximum(out.emission[s] * np.exp([rng.gauss(0, 0.5) for _ in range(4)]), 1e-3)
        out.emission[s] = e / e.sum()
    elif kind < 0.8:
        out.emission[g.states] = np.roll(out.emission[g.states], rng.choice([1, -1]), axis=0)
    else:
        enter = out.transition[0, g.states]
        share = min(0.5, enter.sum() * np.exp(rng.gauss(0, 0.5)))
        rest = 1 - enter.sum()
        out.transition[0] *= (1 - share) / rest
        out.transition[0, g.states] = enter / enter.sum() * share
    return out


def find_model_mcmc(seqs: DataFrame, start, measure: str = "mi", chains: int = 6, steps: int = 1000, temperature: float = 1e-3, seed: int = 1) -> list[tuple[float, object]]:
    """(score, model) visited from a first model with a motif, best first; one pass over the data for each proposal."""
    from ..models.training import objective

    data = seqs.persist()
    out = parallel_tempering([start] * chains, [temperature / 2**i for i in range(chains)], steps, model_moved, lambda models: [objective(data, m, measure, gradient=False)[0] for m in models], seed)
    data.unpersist()
    return out
