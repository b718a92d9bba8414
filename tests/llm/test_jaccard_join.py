import random

import numpy as np
from pyspark.sql import functions as F

from kontrast.llm import common, jaccard_join
from kontrast.llm.common import least_reachable
from kontrast.llm.jaccard_join import link, links_within, pack, shingle_sets, unpack


def brute(rows, width=4, percent=85):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, set()).update([tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))] if w else [])
    at = {i: i for i in sets if i is not None}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    ids = sorted(at)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                at[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def compare(df):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in link(df).collect() if r.doc_id is not None}
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    assert got == want
    return want


def test_edges_and_chains(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (6, "one two three"), (7, "é a b c"), (None, "one two"), (8, "x " * 50)]
    k = 10
    for base_n in (5, 12, 30, 80, 200):
        base = [rng.choice(vocab) for _ in range(base_n)]
        for _ in range(25):  # a random walk of edits from one text: some pairs link, some only through others
            if rng.random() < 0.7:
                base = list(base)
                base[rng.randrange(len(base))] = rng.choice(vocab)
            rows.append((k, " ".join(base)))
            k += 1
    line = [rng.choice(vocab) for _ in range(12)]
    for n in (2, 3, 6, 20):  # a common line with own words
        for _ in range(20):
            rows.append((k, " ".join(line + [rng.choice(vocab) for _ in range(n)])))
            k += 1
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n int")
    want = compare(df)
    assert len({c for _, c in want.values()}) < len(want) - 40
    assert link(df.limit(0)).count() == 0


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    copies = df.withColumn("doc_id", F.col("doc_id") + 100000).withColumn("text", F.concat("text", F.lit(" more words"))).where("doc_id % 10 = 0")
    compare(df.select("doc_id", "text").union(copies.select("doc_id", "text")))


def by_matrix(rows, width=4, percent=85):
    """Components from the products of all pairs of sets, as a matrix."""
    sets = shingle_sets([t for _, t in rows], width)
    tokens, at = np.unique(np.concatenate(sets), return_inverse=True)
    x = np.zeros((len(sets), len(tokens)), np.float32)
    x[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), at] = 1
    n = x.sum(1)
    both = x @ x.T
    links = 100 * both >= percent * (n[:, None] + n[None] - both)
    least = np.arange(len(sets))
    while True:
        new = np.where(links, least[None], len(sets)).min(1)
        if (new == least).all():
            return {i: (len(s), rows[k][0]) for (i, _), s, k in zip(rows, sets, least, strict=True)}
        least = new


def test_many_near_copies_around_the_threshold(spark, monkeypatch):
    """3,000 copies of one text with one to six words changed, some alike: most pairs fail by little."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(3000):
        t = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 4, 5, 6])):
            t[rng.randrange(120)] = rng.choice(["x", "y", f"own{i}"])
        rows.append((i, " ".join(t)))
    want = by_matrix(rows)
    assert 20 < len({c for _, c in want.values()}) < 2500
    made = []
    real = jaccard_join.stars
    monkeypatch.setattr(jaccard_join, "stars", lambda *a: made.append(real(*a)) or made[-1])
    monkeypatch.setattr(jaccard_join, "CHUNK_TOKENS", 5000)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(jaccard_join, "release", lambda *a: None)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in link(df).collect()} == want
    pairs = sum(x.select(x.columns[-2:]).distinct().count() for x in made)
    assert pairs < 40 * len(rows), pairs


def test_rows_of_one_id(spark):
    """Each row goes by its own text; texts of one id are linked by nothing else."""
    t, u = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    df = spark.createDataFrame([(1, t), (1, u), (2, t + " z"), (3, u + " z"), (3, u + " z"), (4, None), (4, "c")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in link(df).collect())
    assert got == [(1, 37, 1), (1, 37, 1), (2, 38, 1), (3, 38, 1), (3, 38, 1), (4, 0, 4), (4, 1, 4)]


def test_very_long_texts(spark):
    long = [f"v{i}" for i in range(300_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[: 260_000])), (3, " ".join(long[:200_000])), (4, " ".join(reversed(long)))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (299_997, 1), 2: (259_997, 1), 3: (199_997, 3), 4: (299_997, 4)}


def test_packed_numbers():
    rng = np.random.default_rng(2)
    for n in (1, 2, 1000):
        t = np.unique(rng.integers(0, 2**64, n, np.uint64))
        v = rng.integers(0, 2**16, len(t)).astype(np.uint16)
        a, b = unpack(pack(t, v))
        assert (a == t).all() and (b == v).all()


def near_copies(groups, size):
    """Copies of some texts of 90 words with one to six words changed, some alike: most pairs fail by little."""
    rng = random.Random(4)
    rows = []
    for g in range(groups):
        for _ in range(size):
            t = [f"g{g}w{i}" for i in range(90)]
            for _ in range(rng.choice([1, 2, 3, 4, 4, 5, 6])):
                t[rng.randrange(90)] = rng.choice(["x", "y", f"own{len(rows)}"])
            rows.append((len(rows), " ".join(t)))
    return rows


def linked_by_turns(spark, rows, monkeypatch):
    """What ``link`` gives of ``rows``, and how many rows each turn cuts."""
    turns, real = [], jaccard_join.candidates
    monkeypatch.setattr(jaccard_join, "candidates", lambda balls, percent: turns.append(balls.count()) or real(balls, percent))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in link(df, 5, 80).collect()}, turns


def test_bounded_balls_take_no_turns(spark, monkeypatch):
    """The turns' rows would grow with the square of a group's size."""
    rows = near_copies(20, 60)
    got, turns = linked_by_turns(spark, rows, monkeypatch)
    assert got == by_matrix(rows, 5, 80)
    assert not turns


def test_larger_balls_are_cut_by_turns(spark, monkeypatch):
    """As above with balls beyond the bound and edges beyond what one task joins."""
    rows = near_copies(3, 250)
    monkeypatch.setattr(jaccard_join, "BALL_NODES", 20)
    monkeypatch.setattr(common, "TASK_EDGES", 0)
    got, turns = linked_by_turns(spark, rows, monkeypatch)
    assert got == by_matrix(rows, 5, 80)
    assert turns


def test_links_within_a_ball(monkeypatch):
    """Few columns at a time, empty differences, own tokens: the same components as from all pairs."""
    monkeypatch.setattr(jaccard_join, "COLUMNS", 3)
    rng = np.random.default_rng(5)
    for _ in range(50):
        d = [rng.permutation(12)[: rng.integers(0, 8)] for _ in range(15)]
        n, own, component = rng.integers(10, 40, 15), rng.integers(0, 3, 15), rng.integers(0, 9, 15)
        edges = [(component[i], component[j]) for i in range(15) for j in range(i) if component[i] != component[j] and 180 * (own[i] + own[j] + len(set(d[i]) ^ set(d[j]))) <= 20 * (n[i] + n[j])]
        want = least_reachable(*np.array(edges, np.int64).reshape(-1, 2).T)
        a, b = links_within(n, own, component, d, 80)
        assert dict(zip(*want, strict=True)) == dict(zip(a, b, strict=True)) | {x: x for x in b}
