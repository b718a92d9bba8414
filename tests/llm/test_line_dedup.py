import random

from kontrast.llm.line_dedup import deletion_hashes, drop_repeated_lines


def within_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :] or a == b


def brute(rows, least=16):
    first, lines = {}, []
    for at, (i, t) in enumerate(sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is None, r[0] or 0))):
        for k, x in enumerate(t.split("\n")):
            if len(x) >= least:
                first.setdefault(x, (at, i, k))
    near = {x for x, f in first.items() if any(g < f and within_one(x, y) for y, g in first.items())}
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, t, 0, 0))
            continue
        kept = [x for k, x in enumerate(t.split("\n")) if len(x) < least or (first[x][1:] == (i, k) and x not in near)]
        out.append((i, "\n".join(kept), t.count("\n") + 1, t.count("\n") + 1 - len(kept)))
    return sorted(out, key=str)


def test_hashes_of_deletions():
    s = "aabcé😀dd"
    own, keys = deletion_hashes(s)
    for i in range(len(s)):
        assert keys[i] == deletion_hashes(s[:i] + s[i + 1 :])[0]
    assert len(set(keys.tolist())) == len({s[:i] + s[i + 1 :] for i in range(len(s))})
    assert len(deletion_hashes("x")[1]) == 1


def test_random_edits_and_edges(spark):
    rng = random.Random(5)
    pool = ["".join(rng.choice("ab é") for _ in range(rng.choice([15, 16, 17, 18, 33, 60]))) for _ in range(25)]
    rows = []
    for i in range(120):
        out = []
        for _ in range(rng.randrange(1, 6)):
            x = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                k, op = rng.randrange(len(x)), rng.randrange(3)
                x[k : k + (op != 0)] = [] if op == 1 else [rng.choice("ab é")]
            out.append("".join(x))
        rows.append((i, "\n".join(out)))
    rows += [(500, None), (501, ""), (502, "\n\n"), (None, pool[0]), (503, "é" * 5000 + "\n" + "é" * 4999 + "\n" + "short")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, no int")
    got = sorted((tuple(r) for r in drop_repeated_lines(df).collect()), key=str)
    assert got == brute(rows)
    twice = drop_repeated_lines(df.where("doc_id < 5").union(df.where("doc_id < 5"))).collect()
    assert len(twice) == 10 and len({tuple(r) for r in twice}) == 5
    assert drop_repeated_lines(df.limit(0)).count() == 0


def test_rows_of_one_id(spark):
    """Rows that repeat only the id are judged each: of two near lines one goes, whatever the ids."""
    a, b = "abcdefghijklmnopqrst", "abcdefghijklmnopqrsX"
    for ids in ((1, 1), (1, 2), (None, None), (None, 1)):
        df = spark.createDataFrame([(ids[0], a), (ids[1], b)], "doc_id long, text string")
        assert sorted(r.n_dropped for r in drop_repeated_lines(df).collect()) == [0, 1], ids
