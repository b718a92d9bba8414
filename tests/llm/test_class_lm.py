import math
import zlib
from collections import Counter

import numpy as np

from kontrast.llm import class_lm
from kontrast.llm.class_lm import exchange, score


def tokens(t):
    return [*(t or "").encode().lower().split(), None]


def brute(rows):
    train = [t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return sorted(((i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(w := tokens(t)), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for i, t in rows), key=str)


def test_base_columns_and_held_out_gain(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = score(df).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == brute([tuple(r) for r in df.collect()])
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 for r in got)


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(class_lm, "CHUNK_WORDS", 5)
    rows = [(1, None), (2, ""), (3, "The the\x0bTHE é É"), (None, "unknown words"), (3, "The the"), (9, " \t"), (16, "the end")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    got = score(df).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == brute(rows)
    assert score(df.limit(0)).count() == 0


def test_exchange_finds_planted_classes_and_never_loses():
    rng = np.random.default_rng(0)
    kind, words = np.arange(60) % 3, 60
    step = np.array([[0.05, 0.9, 0.05], [0.05, 0.05, 0.9], [0.9, 0.05, 0.05]])
    n = np.zeros((words + 2, words + 2))
    k = 0
    for _ in range(20000):
        nxt = rng.choice(3, p=step[kind[k]])
        w = rng.choice(np.flatnonzero(kind == nxt))
        n[k, w] += 1
        k = w
    perm = rng.permutation(words)
    full = np.append(perm, [words, words + 1])
    own = exchange(n[np.ix_(full, full)], 3, 10)
    assert len({(a, b) for a, b in zip(own, kind[perm], strict=True)}) == 3


def test_words_beyond_the_commonest_get_classes_too(spark):
    """Words of two kinds take turns, half of them rare: classes that know the kind of rare words halve their choice."""
    rng = np.random.default_rng(1)
    names = [[f"{k}{i}" for i in range(210)] for k in "nv"]
    odds = np.repeat([0.05, 0.0025], [10, 200])
    rows = [(i, " ".join(rng.choice(names[k], p=odds) for _ in range(20) for k in (0, 1))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = [r for r in score(df, top=20).collect() if r.held_out]
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    # with both kinds known throughout it is log10(2), less what smoothing takes
    assert gain > 0.2, gain


def test_score_by_plain_counts(spark, monkeypatch):
    """The score from dictionaries over the classes found; the probabilities of all types sum to 1 after each class."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    odds = 1 / np.arange(1, 301)
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 40), p=odds / odds.sum()))) for i in range(120)] + [(500, "never seen w1"), (501, None)]
    kept = []
    real = class_lm.stored
    monkeypatch.setattr(class_lm, "stored", lambda df, name: kept.append((name, real(df, name))) or kept[-1][1])
    monkeypatch.setattr(class_lm, "release", lambda *a: None)
    monkeypatch.setattr(class_lm, "CHUNK_WORDS", 700)
    got = {r.doc_id: r.score for r in score(spark.createDataFrame(rows, "doc_id long, text string"), top=40).collect()}
    state = [df for name, df in kept if name == "classes"][-1].where("what = 'vocabulary'").collect()
    own = {int(h): int(c & 127) for r in state for h, c in zip(np.frombuffer(r.a, "<u8"), np.frombuffer(r.c, np.uint8))}
    hash_of = lambda w: 0 if w is None else int(class_lm.word_hashes([w.decode()])[0][0])
    train = [tokens(t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in t)
    cls = {w: own[hash_of(w)] for w in c}
    unknown, last = class_lm.UNKNOWN, class_lm.LAST
    assert cls[None] == last and len({cls[w] for w in c}) > 5
    pairs = Counter()
    for t in train:
        for a, b in zip([None, *t], t):
            pairs[cls[a], cls[b]] += 1
            if c[b] == 1:
                pairs[cls[a], unknown] += 1
            if a is not None and c[a] == 1:
                pairs[unknown, cls[b]] += 1
                if c[b] == 1:
                    pairs[unknown, unknown] += 1
    used = sorted({*cls.values(), unknown})
    total = sum(pairs.values())
    share = {k: (sum(pairs[a, k] for a in used) + 0.5) / (total + 0.5 * len(used)) for k in used}
    mass = Counter()
    for w, n in c.items():
        mass[cls[w]] += n

    def p(a, b):
        return (pairs[a, b] + class_lm.SMOOTHING * share[b]) / (sum(pairs[a, k] for k in used) + class_lm.SMOOTHING)

    for a in used:  # all types: the words of each class, the end, the unknown one
        assert abs(sum(p(a, cls[w]) * c[w] / mass[cls[w]] for w in c) + p(a, unknown) - 1) < 1e-9
    for i, t in rows:
        want, a = 0.0, last
        for w in tokens(t):
            b = cls.get(w, unknown)
            want += math.log10(p(a, b) * (c[w] / mass[b] if w in c else 1))
            a = b
        assert abs(want - got[i]) < 1e-6 * max(1, abs(want)), i
