"""Association measures as Column expressions over a contingency table: rows are sets, columns presence and absence.

``cells`` is a list of (present, size) Columns, one for each set; the first is the signal where order matters. A
pseudo-count is added to every cell. Empty cells add nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Cells = list[tuple[Column, Column]]
LN2 = math.log(2)
FIXED_CORRECTION = math.log(149)


def _table(cells: Cells, ps: float) -> tuple[list[tuple[Column, Column, Column]], Column, Column, Column]:
    rows = []
    for k, n in cells:
        k, n = k.cast("double"), n.cast("double")
        a, b = k + F.lit(float(ps)), n - k + F.lit(float(ps))
        rows.append((a, b, a + b))
    add = lambda xs: sum(xs[1:], xs[0])
    return rows, add([r[0] for r in rows]), add([r[1] for r in rows]), add([r[2] for r in rows])


def _terms(cells: Cells, ps: float):
    rows, present, absent, z = _table(cells, ps)
    for a, b, size in rows:
        for x, col in ((a, present), (b, absent)):
            yield x, x / z, F.when(x > 0, F.log(x * z / (size * col))).otherwise(F.lit(0.0))


def mutual_information(cells: Cells, ps: float = 1.0) -> Column:
    """Bits that presence and set tell of each other."""
    xs = [p * log for _, p, log in _terms(cells, ps)]
    return sum(xs[1:], xs[0]) / LN2


def total(cells: Cells, ps: float = 1.0) -> Column:
    return _table(cells, ps)[3]


def corrected_mi(cells: Cells, ps: float = 1.0, form: str = "seed") -> Column:
    """With (R - 1)(C - 1) / (z + 1) added in the form used for seeds, and half of it in that used for models."""
    extra = F.lit(float(len(cells) - 1)) / (total(cells, ps) + 1.0)
    return mutual_information(cells, ps) + (extra if form == "seed" else extra / 2)


def mi_variance(cells: Cells, ps: float = 1.0, form: str = "seed") -> Column:
    """Variance of the estimate: mean squared log ratio less the squared (seed form: corrected) information, over z + 1."""
    xs = [p * log * log for _, p, log in _terms(cells, ps)]
    j = corrected_mi(cells, ps) if form == "seed" else mutual_information(cells, ps)
    return (sum(xs[1:], xs[0]) / LN2 - j * j) / (total(cells, ps) + 1.0)


def g_statistic(cells: Cells, ps: float = 1.0) -> Column:
    return 2 * LN2 * total(cells, ps) * mutual_information(cells, ps)


def log_likelihood_ratio(cells: Cells, ps: float = 1.0) -> Column:
    return -LN2 * total(cells, ps) * mutual_information(cells, ps)


def chi_square(cells: Cells, ps: float = 0.0) -> Column:
    rows, present, absent, z = _table(cells, ps)
    xs = []
    for a, b, size in rows:
        for x, col in ((a, present), (b, absent)):
            e = size * col / z
            xs.append(F.when(e > 0, (x - e) * (x - e) / e).otherwise(F.lit(0.0)))
    return sum(xs[1:], xs[0])


def mcc(cells: Cells, ps: float = 0.0) -> Column:
    """Matthews correlation of two sets, 0 where a marginal is 0."""
    rows, present, absent, _ = _table(cells[:2], ps)
    (tp, fn, s), (fp, tn, c) = rows
    d = s * c * present * absent
    return F.when(d > 0, (tp * tn - fp * fn) / F.sqrt(d)).otherwise(F.lit(0.0))


def frequency(cells: Cells, which: int = 0, ps: float = 0.0) -> Column:
    a, _, size = _table(cells, ps)[0][which]
    return F.when(size > 0, a / size).otherwise(F.lit(0.0))


def delta_frequency(cells: Cells, ps: float = 0.0) -> Column:
    return frequency(cells, 0, ps) - frequency(cells, 1, ps)


def chi2_log_sf(x: np.ndarray, df: int) -> np.ndarray:
    """ln P(chi square with df degrees of freedom >= x), without underflow: series or continued fraction of the
    regularized upper incomplete gamma function."""
    out = np.empty(len(x))
    s = df / 2
    for i, v in enumerate(np.asarray(x, float) / 2):
        if not v > 0:
            out[i] = 0.0 if v == v else math.nan
        elif v < s + 1:
            term = total_ = 1 / s
            k = s
            while term > total_ * 1e-17:
                k += 1
                term *= v / k
                total_ += term
            out[i] = math.log1p(-min(1 - 1e-16, math.exp(s * math.log(v) - v - math.lgamma(s)) * total_))
        else:
            tiny = 1e-300
            b = v + 1 - s
            c, d = 1 / tiny, 1 / b
            h = d
            for k in range(1, 500):
                a = -k * (k - s)
                b += 2
                d = 1 / (a * d + b or tiny)
                c = b + a / c or tiny
                h *= d * c
                if abs(d * c - 1) < 1e-16:
                    break
            out[i] = s * math.log(v) - v - math.lgamma(s) + math.log(h)
    return out


def raw_log_p(cells: Cells, ps: float = 1.0) -> Column:
    """Minus ln of the chance of a G at least as large; larger is better. Two degrees of freedom have a closed form."""
    g, df = g_statistic(cells, ps), len(cells) - 1
    if df == 2:
        return F.greatest(F.lit(0.0), g / 2)

    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return pd.Series(-chi2_log_sf(x.to_numpy(), df))

    return tail(g)


@lru_cache
def words_up_to(length: int, most: int) -> float:
    """Number of words of one length whose letters allow at most ``most`` bases beyond one each: letters of one to four
    bases are 4, 6, 4 and 1."""
    ways = [1]
    for _ in range(length):
        nxt = [0] * (len(ways) + 3)
        for d, n in enumerate(ways):
            for extra, letters in enumerate((4, 6, 4, 1)):
                nxt[d + extra] += n * letters
        ways = nxt
    return float(sum(ways[: most + 1]))


def correction(length: int, degeneracy: int, fixed: bool = False, model: bool = False) -> float:
    """ln of the number of words tried. Fixed: ln 149, times the length for models."""
    if fixed or model:
        return FIXED_CORRECTION * (length if model else 1)
    return math.log(words_up_to(length, degeneracy))


def corrected_log_p(cells: Cells, length: int, degeneracy: int, ps: float = 1.0, fixed: bool = False) -> Column:
    return raw_log_p(cells, ps) - correction(length, degeneracy, fixed)


#: Measure by name; each takes (cells, pseudo-count).
MEASURES: dict[str, Callable[[Cells, float], Column]] = {
    "mi": mutual_information, "mic": corrected_mi, "mivar": mi_variance, "gtest": g_statistic, "logp": raw_log_p, "chisq": chi_square,
    "mcc": mcc, "dfreq": delta_frequency, "signal_freq": lambda c, ps: frequency(c, 0), "control_freq": lambda c, ps: frequency(c, 1), "llr": log_likelihood_ratio,
}
#: Measures that compare the first set with the second and take no pseudo-count unless asked.
TWO_SETS = {"mcc", "dfreq", "signal_freq", "control_freq"}


def measure(name: str, cells: Cells, ps: float = 1.0, enriched_only: bool = False) -> Column:
    """One measure by name. A contrast of one set scores -inf, except by signal_freq; with ``enriched_only`` so does a
    word that is rarer in the signal than in the control."""
    if name not in MEASURES:
        raise ValueError(f"no measure is called {name}; there are {', '.join(MEASURES)}")
    if len(cells) < 2 and name != "signal_freq":
        return F.lit(-math.inf)
    value = MEASURES[name](cells, 0.0 if name in TWO_SETS else ps)
    if enriched_only and len(cells) >= 2:
        return F.when(frequency(cells, 0) < frequency(cells, 1), F.lit(-math.inf)).otherwise(value)
    return value


def combined(parts: Iterable[tuple[int, Column, Column | None]]) -> Column:
    """Signed sum of scores over contrasts; with weights, divided by their sum."""
    parts = list(parts)
    weights = [w if w is not None else F.lit(1.0) for _, _, w in parts]
    top = sum((s * w.cast("double") * x for (s, x, _), w in zip(parts, weights, strict=True)), F.lit(0.0))
    return top / sum((w.cast("double") for w in weights), F.lit(0.0)) if any(w is not None for *_, w in parts) else top
