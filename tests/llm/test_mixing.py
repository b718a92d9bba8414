import collections

from kontrast.llm import mixing
from kontrast.llm.mixing import mix


def brute_targets(sizes, weights=(3, 1, 2), share=1.5):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, free = {}, share * sum(sizes.values()), set(names)
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > 2 * sizes[s]}
        if not over:
            target |= {s: level * w[s] for s in free}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def check(df, slack):
    rows = df.collect()
    got = mix(df).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(str(tuple(r)) for r in mix(df.repartition(3)).collect())
    sizes = collections.Counter()
    src = {}
    for r in rows:
        n = len((r.text or "").replace("\x0b", " ").encode().split())
        sizes[r.source] += n
        src.setdefault(r.doc_id, (r.source, n))
    want, taken = brute_targets(sizes), collections.Counter()
    assert len(got) == len(rows)
    for g in got:
        s, n = src[g.doc_id]
        assert g.size == n and g.source_size == sizes[s] and abs(g.target - want[s]) <= 1e-6 * (1 + want[s])
        assert 0 <= g.taken <= 2 * n
        taken[s] += g.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= slack * want[s] + 2, (s, taken[s], want[s])


def test_whole_table(spark):
    check(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), 0.05)


def test_edges(spark):
    rows = [(i, "a b\tc\x0bd " * (i % 7), ["x", "y", None, "é", "Z"][i % 5], 1) for i in range(200)] + [(500, None, "x", 1), (501, "", None, 1), (502, "   ", "empty", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    check(df, 0.2)
    assert mix(df.limit(0)).count() == 0
    assert [r.taken for r in mix(df.where("doc_id = 501")).collect()] == [0]


def test_rates_solve_the_dual_and_are_the_nearest_in_entropy(spark):
    """The tilt equals that of a bisection, and no small change that keeps the words lowers the entropy distance."""
    import random

    import numpy as np

    rng = random.Random(2)
    rows = [(i, rng.choice("xyz"), " ".join("w" * rng.choice([1, 1, 2, 5, 40, 300]))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sized = mixing.stored(df.select("doc_id", "source", mixing.word_count().alias("size")), "sized")
    targets = mixing.stored(mixing.source_targets(sized, (3, 1, 2), 1.5), "targets")
    goal = {r.source: r for r in targets.collect()}
    for r in mixing.tilts(sized, targets).collect():
        size = np.array([len(t.split()) for _, s, t in rows if s == r.source], float)
        target = goal[r.source].target
        if target >= 2 * size.sum() * (1 - 1e-9):
            assert r.tilt >= 700
            continue
        words = lambda tilt: (size * 2 / (1 + np.exp(-tilt * size / r.unit))).sum()
        lo, hi = -60.0, 60.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if words(mid) < target else (lo, mid)
        assert abs(words(r.tilt) - target) < 1e-5 * target and abs(r.tilt - lo) < 1e-3
        p = 1 / (1 + np.exp(-r.tilt * size / r.unit))
        distance = lambda q: (q * np.log(2 * q) + (1 - q) * np.log(2 * (1 - q))).sum()
        for seed in range(20):
            step = np.random.default_rng(seed).standard_normal(len(size))
            step -= size * (step @ size) / (size @ size)
            q = p + 1e-4 * step * np.minimum(p, 1 - p)
            q -= size * ((q - p) @ size) / (size @ size)
            if (q > 0).all() and (q < 1).all():
                assert distance(q) >= distance(p) - 1e-9


def test_ties_and_very_long_texts(spark):
    """Equal documents get as many copies as their rates sum to, within one; a text of 400,000 words is taken whole or not."""
    rows = [(i, "a", "one two three") for i in range(90)] + [(1000 + i, "b", "w " * n) for i, n in enumerate([400_000, 5, 5, 5])]
    got = mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    a = [r.taken // 3 for r in got if r.doc_id < 1000]
    target = next(r.target for r in got if r.doc_id < 1000)
    assert abs(3 * sum(a) - target) <= 3 * 2 and max(a) - min(a) <= 1
    assert next(r for r in got if r.doc_id == 1000).size == 400_000
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got)
