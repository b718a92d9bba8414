import itertools
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from kontrast.llm import quality
from kontrast.llm.quality import classify, features, shape


def test_shapes():
    assert [shape(w) for w in ("THE!!!", "a1.50", "|", "É", "Thre***")] == ["X!!", "x9.9", "|", "x", "x**"]


def test_held_out_accuracy_and_brute_force(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    half = F.xxhash64("doc_id", F.lit(77)) % 2 == 0
    out = classify(docs, labels.where(half)).toPandas().set_index("doc_id")
    held = labels.where(~half).toPandas().set_index("doc_id").join(out, how="inner")
    clean = (held.quality == 1) & (held.toxic == 0)
    assert held[clean].kept.mean() > 0.95
    assert held[held.toxic == 1].kept.mean() < 0.3  # learnt from some 200 toxic texts
    assert held[held.quality == 0].kept.mean() < 0.2
    # the same model from plain counts
    rows = {r.doc_id: r.text for r in docs.collect()}
    kinds = {r.doc_id: 2 if r.toxic else 1 - r.quality for r in labels.where(half).collect()}
    every, by, n = np.zeros(1 << quality.BITS), np.zeros((3, 1 << quality.BITS)), np.zeros(3)
    for i, t in rows.items():
        b = features([t])[1]
        every[b] += 1
        if i in kinds:
            by[kinds[i]][b] += 1
            n[kinds[i]] += 1
    m = quality.Model(every, by, n)
    ids = sorted(rows)[:500]
    assert np.allclose(m.log_share([rows[i] for i in ids]) - m.prior[0], out.loc[ids].log_weight.to_numpy())
    k = out.kept.sum()
    assert out.key.nlargest(k).min() == out[out.kept].key.min()


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (3, "a b", "x"), (3, "a b", "x"), (4, "퟿ z", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(3, 1, 0), (2, None, 0), (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    out = classify(docs, labels).collect()
    assert len(out) == 6 and all(r.kept for r in out if r.doc_id in (1, 2))
    assert all(r.kept for r in classify(docs, labels.limit(0)).collect())
    assert classify(docs.limit(0), labels).count() == 0


def plain_features(text):
    """The features as tuples of strings, by loops of their own."""
    out, before = set(), None
    folded = []
    for word in (text or "").split():
        shape = ""
        for letters, run in itertools.groupby(word, key=lambda c: "L" if c.isalpha() else "9" if c.isdigit() else c):
            run = "".join(run)
            shape += ("X" if len(run) > 1 and run.isupper() else "x") if letters == "L" else "9" if letters == "9" else run[:2]
        low = word.lower().strip(".,")
        folded.append((shape, before is not None and low == before))
        out.add(("word", low))
        out.add(("shape", *folded[-1]))
        before = low
    return out | {("two", a, b) for a, b in itertools.pairwise(folded)}


def test_weights_by_plain_counts_and_sampling(spark):
    """log_weight from dictionaries of features; at temperature 1 the k kept are a weighted sample."""
    rng = random.Random(6)
    pools = {0: "sun moon tree 12 river.".split(), 1: "BUY!!! now $$$ 99 NOW!!".split(), 2: "awful rotten nasty sun moon".split()}
    rows, labels = [], []
    for i in range(300):
        c = rng.choice([0, 0, 0, 1, 2])
        rows.append((i, " ".join(rng.choice(pools[c] + pools[0]) for _ in range(rng.randrange(1, 40)))))
        if i % 2:
            labels.append((i, 0 if c == 1 else 1, int(c == 2)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    kind = {i: 2 if t else 1 - q for i, q, t in labels}
    every, by = Counter(), [Counter(), Counter(), Counter()]
    for i, t in rows:
        f = plain_features(t)
        every.update(f)
        if i in kind:
            by[kind[i]].update(f)
    size, all_ = 1 << quality.BITS, sum(every.values())
    n = [sum(k == c for k in kind.values()) for c in range(3)]

    def log_ratio(c, f):
        base, total = (every[f] + 0.5) / (all_ + 0.5 * size), sum(by[c].values())
        n, m = by[c][f] + 0.5, total * base + 0.5
        z = abs(math.log(n / m)) / math.sqrt(1 / n + 1 / m + 0.7**2)
        return math.log((by[c][f] + 2000 * base) / (total + 2000) / base) * z**4 / (z**4 + 3.0**4)

    for i, t in rows:
        s = [math.log((n[c] + 1) / (sum(n) + 3)) + sum(log_ratio(c, f) for f in plain_features(t)) for c in range(3)]
        raw = math.log(sum(math.exp(x - max(s)) for x in s)) + max(s)
        assert abs(s[0] - raw - math.log((n[0] + 1) / (sum(n) + 3)) - out[i].log_weight) < 1e-3, i
    assert sum(r.kept for r in classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), k=40).collect()) == 40
    # texts of equal weight: each is as likely as any other to be among the k
    same = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("sun").alias("text"))
    kept = {r.doc_id for r in classify(same, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), k=1000).where("kept").collect()}
    assert len(kept) == 1000 and 420 < sum(i < 2000 for i in kept) < 580
