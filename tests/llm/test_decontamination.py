import hashlib
import re

from kontrast.llm.decontamination import contamination, matches

SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return SPLIT.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, n=10):
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - n + 1)) if w and i is not None else ():
            wins.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for k in range(len(w)):
            for size in {len(x) for x in wins}:
                if k + size <= len(w) and (ids := wins.get(tuple(w[k : k + size]))):
                    hit |= set(range(k, k + size))
                    found |= ids
        ids = ",".join(sorted(map(str, found)))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


def test_edges(spark):
    ten = "One two, three four five six seven eight nine ten"
    items = [(1, ten + " eleven"), (2, "short Ünit"), (10, "short Ünit"), (3, None), (4, ""), (5, "a a a a a a a a a a a"), (None, "zebra"), (1, "other words")]
    docs = [(1, "x " + ten.upper() + " eleven y"), (2, None), (3, ""), (4, "a " * 25), (5, "a " * 9), (6, "the short\nÜnit short ünit Short Ünit"), (7, "ten nine"), (None, "short Ünit"), (8, "other words " * 3), (9, "one two three four five six seven eight nine x ten")]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, n_hit int")
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, words int")
    got = sorted((tuple(r)[:6] for r in contamination(d, b).collect()), key=str)
    assert got == sorted(brute(docs, items), key=str)
    assert contamination(d.limit(0), b).count() == 0
    assert all(not r.contaminated for r in contamination(d, b.limit(0)).collect())
    near = {r.doc_id for r in matches(d, b, slop=1)[0].collect()}
    assert 9 in near and 7 not in near


def test_each_row_goes_by_its_own_text(spark):
    ten = "one two three four five six seven eight nine ten"
    docs = [(1, "one two three four five"), (1, "six seven eight nine ten"), (2, ten), (2, "clean words only"), (None, ten), (None, None), (3, ten), (3, ten)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(7, ten)], "item_id long, text string")
    got = sorted((tuple(r)[:6] for r in contamination(d, b).collect()), key=str)
    assert got == sorted(brute(docs, [(7, ten)]), key=str)


def test_near_matches_and_long_texts(spark):
    """Proximity against plain loops over random texts of few words; a text of 300,000 words is taken whole."""
    import random

    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randrange(30)))) for i in range(150)]
    docs += [(900, "x " * 299_990 + "a b c d"), (901, None)]
    items = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randrange(1, 7)))) for i in range(12)] + [(50, "a b c d")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    df = {}
    for _, t in docs:
        for w in words(t):
            df[w] = df.get(w, 0) + 1
    want = {}
    for i, t in docs:
        ws, near = words(t), set()
        at = {w: {k for k, x in enumerate(ws) if x == w} for w in set(ws)}
        for item, text in items:
            q = words(text)
            for k in range(max(1, len(q) - 3)):
                win = q[k : k + 4]
                o = min(range(len(win)), key=lambda j: (df.get(win[j], 0), win[j], j))
                if any(all(at.get(w, set()) & {p - o + j - 1, p - o + j, p - o + j + 1} for j, w in enumerate(win)) for p in at.get(win[o], ())):
                    near.add(item)
        want[i] = len(near)
    got = contamination(d, b, n=4).collect()
    assert {r.doc_id: r.n_near for r in got} == want and sum(want.values()) > 100
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(brute(docs, items, 4), key=str)
