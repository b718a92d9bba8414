import hashlib
import random
import re

import numpy as np

from kontrast.llm.pii import KINDS, Field, base_spans, find_personal_data, luhn, training_set

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 14 <= len(digits) <= 19 and luhn(digits)) or (kind == "phone" and 10 <= len(digits) <= 15)
            if ok:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def test_base_equals_plain_patterns():
    rng = random.Random(2)
    for _ in range(4000):
        t = "".join(rng.choice(["1", "25", "4111", ".", "-", " ", "+", "@", "a", "b.c", "(", ")", "é", "_", "\n", "0", "٣"]) for _ in range(rng.randrange(0, 40)))
        assert base_spans(t) == plain(t), t
    for t in ("1" * 200_000, "a." * 100_000, "a@" * 50_000, "1.2." * 50_000, "+1 " * 50_000):
        assert len(base_spans(t)) >= 0


def test_field_finds_held_out_forms_and_leaves_numbers_alone():
    field = Field()
    field.learn(training_set([], []))
    held = training_set([], [], n=300, seed=99)
    right = wrong = missed = 0
    for text, gold in held:
        got, want = set(field.decode(text, 0, len(text))), set(gold)
        right, wrong, missed = right + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert right / (right + missed) > 0.9 and right / (right + wrong) > 0.9


def test_edges(spark):
    texts = [None, "", "call (555) 123-4567 now", "a.b@c.de and 10.0.0.1", "no data here", "4111 1111 1111 1111", "é" * 3000 + " +1 (487) 555-7209"]
    df = spark.createDataFrame([(i if i else None, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    got = {r.doc_id: r for r in find_personal_data(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        base = plain(t or "")
        r = got[i if i else None]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for x, *_ in base) for k in KINDS)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(filter(None, r.spans.split(",")))
    assert "phone:5:19" in got[2].spans and got[4].spans == ""
    assert find_personal_data(df.limit(0)).count() == 0


def test_decoding_and_gradient_by_enumeration():
    """All segmentations of short texts: the best one is the decoded one, their sum is the partition function, and the
    derivatives are those of differences."""
    rng = np.random.default_rng(4)
    field = Field()
    field.steps = rng.standard_normal((5, 5))
    for text in ("call 555 123 4567", "x a@b.c 1.2.3.4", "1234567 89", "nothing"):
        tokens, ending = field.lattice(text, 0, len(text))
        for xs in ending.values():
            for _, names in xs:
                for f in names:
                    field.weights.setdefault(f, rng.standard_normal(4))
        segments = [(i, j, names) for j, xs in ending.items() for i, names in xs]

        def paths(at, label):
            if at == len(tokens):
                yield 0.0, ()
                return
            for score, rest in paths(at + 1, 0):
                yield score + field.steps[label, 0], rest
            for i, j, names in segments:
                if i == at:
                    w = field.scores(names)
                    for c in range(4):
                        for score, rest in paths(j, c + 1):
                            yield score + field.steps[label, c + 1] + w[c], ((i, j, c), *rest)

        every = list(paths(0, 0))
        best = max(every)[1]
        assert field.decode(text, 0, len(text)) == [(KINDS[c], tokens[i][0], tokens[j - 1][1]) for i, j, c in best]
        score, path = every[rng.integers(len(every))]
        told, grad, steps = field.gradient(len(tokens), ending, {(i, j): c for i, j, c in path})
        assert abs(told - (score - np.logaddexp.reduce([x for x, _ in every]))) < 1e-9
        for f in list(grad)[:3]:
            for c in range(4):
                field.weights[f][c] += 1e-5
                up = field.gradient(len(tokens), ending, {(i, j): c for i, j, c in path})[0]
                field.weights[f][c] -= 2e-5
                down = field.gradient(len(tokens), ending, {(i, j): c for i, j, c in path})[0]
                field.weights[f][c] += 1e-5
                assert abs((up - down) / 2e-5 - grad[f][c]) < 1e-4
        field.steps[0, 0] += 1e-5
        up = field.gradient(len(tokens), ending, {(i, j): c for i, j, c in path})[0]
        field.steps[0, 0] -= 1e-5
        assert abs((up - told) / 1e-5 - steps[0, 0]) < 1e-3


def test_whole_table_and_repeated_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = find_personal_data(df.union(df.where("doc_id < 5")), sample=300).collect()
    texts = {r.doc_id: r.text for r in df.collect()}
    assert len(got) == len(texts) + 5 and len({tuple(r) for r in got}) == len(texts)
    for r in got:
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in plain(texts[r.doc_id] or ""))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(filter(None, r.spans.split(",")))
