"""Personal data: base patterns, and a semi-Markov conditional random field that adds spans they miss."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hashed_share, read

KINDS = ("email", "ip", "card", "phone")
#: Longest candidate segment in tokens and code points, and the context read around each digit or at-sign.
MOST_TOKENS, MOST_CHARS, CONTEXT = 24, 64, 96
#: Texts whose stretches can teach the field, stretches and filler words taken from them, and the length of a stretch.
SAMPLE, STRETCHES, FILLERS, PIECE = 2000, 750, 4000, 600

# --- base patterns, each in time linear in the text ---

_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_dotted = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
_number = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_part = re.compile(r"[0-9]+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by start, then in the order of KINDS.

    A local part reaches back from its at-sign as far as its characters go, which is where the leftmost match begins.
    Patterns of digits begin where a run of digits does, so no run is read again from its middle.
    """
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := _domain.match(text, at + 1)):
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _dotted.finditer(text):
        parts = list(_part.finditer(m[0]))
        for k in range(0, len(parts) - 3, 4):
            if all(len(p[0].lstrip("0")) <= 3 and int(p[0]) <= 255 for p in parts[k : k + 4]):
                out.append(("ip", m.start() + parts[k].start(), m.start() + parts[k + 3].end()))
    for m in _number.finditer(text):
        if len(m[0]) < 40:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _phone.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# --- the random field ---

_trigger = re.compile(r"[0-9]+|@|[\[({<] ?at ?[\])}>]", re.A | re.I)
_token = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.S)
_material = re.compile(r"[0-9A-Za-z ._%+\-()\[\]{}<>:@/]*\Z")
_numeric = re.compile(r"[0-9 .+\-()/]*\Z")
_address = re.compile(r"[A-Za-z0-9._%+-]+(?: ?@ ?| ?[\[({<] ?at ?[\])}>] ?)[A-Za-z0-9-]+(?:(?: ?\. ?| ?[\[({<] ?(?:dot|\.) ?[\])}>] ?)[A-Za-z0-9-]+)+\Z", re.I)
_quad = re.compile(r"([0-9]{1,3})(\.| ?\[\.\] ?| ?\(\.\) ?)([0-9]{1,3})\2([0-9]{1,3})\2([0-9]{1,3})\Z")
_hex = re.compile(r"[0-9a-fA-F.:()\[\] ]+\Z")
_v6 = re.compile(r"(?:[0-9a-f]{1,4}:){2,7}(?::?[0-9a-f]{1,4}){1,6}\Z", re.I)


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around digits, at-signs and bracketed ``at``: no candidate segment lies outside or crosses their ends."""
    begin = end = -1
    for m in _trigger.finditer(text):
        a, b = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        if a <= end:
            end = b
        else:
            if end >= 0:
                yield begin, end
            begin, end = a, b
    if end >= 0:
        yield begin, end


def side(c: str) -> str:
    return "end" if not c else "d" if c.isdigit() else "a" if c.isalpha() else "s" if c.isspace() else c


def span_features(text: str, a: int, b: int) -> list[str]:
    """Features of a whole candidate span and what stands around it."""
    s = text[a:b]
    groups = _part.findall(s)
    digits = "".join(groups)
    n = len(digits)
    out = ["bias", f"digits:{min(n, 20)}", "marks:" + "".join(sorted(set(re.sub(r"[0-9A-Za-z]", "", s)))), "first:" + side(s[0]), "last:" + side(s[-1]),
           "left:" + side(text[a - 1 : a]), "right:" + side(text[b : b + 1]), "beyond:" + side(text[b : b + 1]) + side(text[b + 1 : b + 2]), "before:" + side(text[a - 2 : a - 1] if a > 1 else "") + side(text[a - 1 : a])]
    if len(groups) <= 6 and n <= 20:
        out.append("groups:" + "-".join(str(len(g)) for g in groups))
    if _numeric.match(s):
        out.append("numeric")
        if 13 <= n <= 19:
            out.append(f"luhn:{luhn(digits)}")
        balanced = s.count("(") == s.count(")") <= 1
        out.append(f"balanced:{balanced}")
    if _address.match(s):
        out.append("address")
    if m := _quad.match(s):
        out.append(f"quad:{all(int(m[k]) <= 255 for k in (1, 3, 4, 5))}")
    if _v6.match(s):
        out.append("v6")
    word = re.search(r"([^\W\d_]+)[:.#]? ?\Z", text[max(0, a - 24) : a])
    out.append("cue:" + (word[1].lower() if word else ""))
    return out


def candidates(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(first token, token after the last) of the segments that could be personal data, by length and kinds of characters
    only: bounded, ending in a letter, digit or closing bracket, and either with an at-sign, or with 7 to 19 digits and no
    letter, or with 4 digits at least, a point or colon, and no letter beyond f."""
    out = []
    for i, (a, e) in enumerate(tokens):
        if text[a].isspace() or not _material.match(text[a:e]):
            continue
        digits, sign, marks, letters = 0, False, False, False
        for j in range(i, min(len(tokens), i + MOST_TOKENS)):
            x, y = tokens[j]
            if y - a > MOST_CHARS:
                break
            t = text[x:y]
            if t.isspace():
                if t != " ":
                    break
                continue
            if not _material.match(t):
                break
            digits += (y - x) if t[0].isdigit() else 0
            sign = sign or t == "@" or t.lower() == "at" and text[x - 1 : x] in tuple("[({< ")
            marks = marks or t in ".:"
            if not t[-1].isalnum() and t not in ")]}":
                continue
            numeric = not sign and not letters and not t[0].isalpha()
            letters = letters or (t[0].isalpha() and not sign)
            if sign or (numeric and 7 <= digits <= 19) or (marks and digits >= 4 and _hex.match(text[a:y])):
                out.append((i, j + 1))
    return out


class Field:
    """Weights of (kind, feature) and of a label after another; label 0 is other text, one token at a time."""

    def __init__(self):
        self.weights: dict[str, np.ndarray] = {}
        self.steps = np.zeros((5, 5))

    def lattice(self, text: str, a: int, b: int):
        tokens = [(a + m.start(), a + m.end()) for m in _token.finditer(text[a:b])]
        ending: dict[int, list[tuple[int, list[str]]]] = {}
        for i, j in candidates(text, tokens):
            ending.setdefault(j, []).append((i, span_features(text, tokens[i][0], tokens[j - 1][1])))
        return tokens, ending

    def scores(self, names: list[str]) -> np.ndarray:
        return sum((self.weights[f] for f in names if f in self.weights), np.zeros(4))

    def decode(self, text: str, a: int, b: int) -> list[tuple[str, int, int]]:
        """The best joint choice of boundaries and kinds in text[a:b]: dynamic programming over (token, label)."""
        tokens, ending = self.lattice(text, a, b)
        if not ending:
            return []
        n = len(tokens)
        best = np.full((n + 1, 5), -np.inf)
        best[0, 0] = 0.0
        back: dict[tuple[int, int], tuple[int, int]] = {}
        for j in range(1, n + 1):
            come = best[j - 1] + self.steps[:, 0]
            k = int(come.argmax())
            best[j, 0], back[j, 0] = come[k], (j - 1, k)
            for i, names in ending.get(j, ()):
                w = self.scores(names)
                into = best[i][:, None] + self.steps[:, 1:]
                k = into.argmax(0)
                for c in range(4):
                    v = into[k[c], c] + w[c]
                    if v > best[j, c + 1]:
                        best[j, c + 1], back[j, c + 1] = v, (i, int(k[c]))
        out, at = [], (n, int(best[n].argmax()))
        while at[0] > 0:
            before = back[at]
            if at[1]:
                out.append((KINDS[at[1] - 1], tokens[before[0]][0], tokens[at[0] - 1][1]))
            at = before
        return out[::-1]

    def gradient(self, n: int, ending: dict, path: dict[tuple[int, int], int]) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Log-likelihood of the segmentation ``path`` {(first token, token after the last): kind} of a text of n tokens, and
        its derivatives by weights and steps: what the path has less its expectation over all segmentations."""
        seg = [(i, j, names, self.scores(names)) for j, xs in sorted(ending.items()) for i, names in xs]
        by_end: dict[int, list] = {}
        for x in seg:
            by_end.setdefault(x[1], []).append(x)
        alpha, beta = np.full((n + 1, 5), -np.inf), np.full((n + 1, 5), -np.inf)
        alpha[0, 0], beta[n] = 0.0, 0.0
        for j in range(1, n + 1):
            alpha[j, 0] = np.logaddexp.reduce(alpha[j - 1] + self.steps[:, 0])
            for i, _, _, w in by_end.get(j, ()):
                alpha[j, 1:] = np.logaddexp(alpha[j, 1:], np.logaddexp.reduce(alpha[i][:, None] + self.steps[:, 1:], 0) + w)
        for j in range(n, 0, -1):
            beta[j - 1] = np.logaddexp(beta[j - 1], self.steps[:, 0] + beta[j, 0])
            for i, _, _, w in by_end.get(j, ()):
                beta[i] = np.logaddexp(beta[i], np.logaddexp.reduce(self.steps[:, 1:] + w + beta[j, 1:], 1))
        z = np.logaddexp.reduce(alpha[n])
        likelihood, grad_steps = -z, np.zeros((5, 5))
        for j in range(1, n + 1):
            grad_steps[:, 0] -= np.exp(alpha[j - 1] + self.steps[:, 0] + beta[j, 0] - z)
        grad: dict[str, np.ndarray] = {}
        for i, j, names, w in seg:
            joint = np.exp(alpha[i][:, None] + self.steps[:, 1:] + (w + beta[j, 1:]) - z)
            grad_steps[:, 1:] -= joint
            g = -joint.sum(0)
            if (i, j) in path:
                g[path[i, j]] += 1
                likelihood += w[path[i, j]]
            for f in names:
                grad[f] = grad.get(f, 0) + g
        label, j = 0, 0
        spans = {i: (j, k + 1) for (i, j), k in path.items()}
        while j < n:
            nxt, now = spans.get(j, (j + 1, 0))
            grad_steps[label, now] += 1
            likelihood += self.steps[label, now]
            label, j = now, nxt
        return float(likelihood), grad, grad_steps

    def learn(self, examples: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 12, rate: float = 0.3, decay: float = 1e-4) -> None:
        """Maximum likelihood by Adagrad; expectations by the forward and backward sums over all segmentations."""
        made = []
        for text, gold in examples:
            tokens, ending = self.lattice(text, 0, len(text))
            starts = {s: k for k, (s, _) in enumerate(tokens)}
            stops = {e: k + 1 for k, (_, e) in enumerate(tokens)}
            path = {(starts.get(s), stops.get(e)): KINDS.index(kind) for kind, s, e in gold}
            known = {(i, j) for j, xs in ending.items() for i, _ in xs}
            if all(p in known for p in path):
                made.append((len(tokens), ending, path))
                for xs in ending.values():
                    for _, names in xs:
                        for f in names:
                            self.weights.setdefault(f, np.zeros(4))
        power = {f: np.full(4, 1e-6) for f in self.weights}
        step_power = np.full((5, 5), 1e-6)
        order = random.Random(7)
        for _ in range(rounds):
            order.shuffle(made)
            for n, ending, path in made:
                _, grad, grad_steps = self.gradient(n, ending, path)
                for f, g in grad.items():
                    g = g - decay * self.weights[f]
                    power[f] += g * g
                    self.weights[f] += rate * g / np.sqrt(power[f])
                step_power += grad_steps**2
                self.steps += rate * grad_steps / np.sqrt(step_power)
        self.weights = {f: w for f, w in self.weights.items() if np.abs(w).max() > 1e-3}


# --- training text ---


def made_up(rng: random.Random) -> tuple[str | None, str]:
    """(kind, string) of one made-up item in a common written form; None: a number that is nobody's data."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9)))
    octet = lambda: str(rng.randint(0, 255))
    kind = rng.choice(["email", "ip", "card", "phone", None, None, None])
    if kind == "email":
        at, dot = rng.choice([("@", "."), ("@", "."), (" [at] ", " [dot] "), ("(at)", "."), (" (at) ", " (dot) "), (" @ ", "."), ("[at]", "[dot]"), ("{at}", ".")])
        return kind, w() + rng.choice(["", "." + w(), d(2), "." + d(2), "_" + w()]) + at + w() + rng.choice(["", d(1), "-" + w()]) + dot + rng.choice(["com", "org", "net", "example" + dot + "com", "de", "fr"])
    if kind == "ip":
        if rng.random() < 0.25:
            return kind, ":".join("%x" % rng.randrange(4096, 65536) for _ in range(8))
        return kind, rng.choice([".", ".", "[.]", "(.)"]).join(octet() for _ in range(4))
    if kind == "card":
        body = rng.choice("3456") + d(rng.choice([13, 14, 14, 14]))
        digits = next(body + c for c in "0123456789" if luhn(body + c))
        cut = rng.choice(["", "", " ", "-", "."])
        return kind, cut.join(digits[k : k + 4] for k in range(0, len(digits), 4))
    if kind == "phone":
        a, b, c = d(3), d(3), d(4)
        return kind, rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+{d(2)} {a} {b} {c}", f"{a}-{b}-{c}", f"+1-{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{d(11)}", f"1-{a}-{b}-{c}", f"({a}) {b} {c}"])
    long = d(rng.choice([14, 15, 16, 17]))
    while luhn(long):
        long = d(len(long))
    return None, rng.choice([d(rng.randint(1, 6)), d(4), long, long, f"{d(1)}.{d(1)}.{d(1)}", f"{d(4)}-{d(2)}-{d(2)}", f"{d(3)},{d(3)}", f"${d(3)}.{d(2)}", f"{d(2)}:{d(2)}:{d(2)}", d(rng.choice([7, 8, 9, 10, 12])), f"{d(4)} {d(4)}", f"{d(2)}/{d(2)}/{d(4)}", f"{rng.randint(256, 999)}.{octet()}.{octet()}.{rng.randint(256, 999)}", f'token = "{"%040x" % rng.getrandbits(160)}"'])


def pieces_of(text: str) -> Iterator[str]:
    """The stretches of a whole text around its triggers, longer ones cut at blanks into pieces of some PIECE code points."""
    for a, b in regions(text):
        while b - a > PIECE:
            cut = text.find(" ", a + PIECE, b)
            if cut < 0:
                break
            yield text[a:cut]
            a = cut + 1
        yield text[a:b]


def training_set(stretches: list[str], fillers: list[str], n: int = 2 * STRETCHES, seed: int = 5) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Stretches of real text with their base matches, and filler words with made-up items between them."""
    rng = random.Random(seed)
    out = []
    for part in stretches:
        gold, end = [], 0
        for s in base_spans(part):
            if s[1] >= end:
                gold.append(s)
                end = s[2]
        out.append((part, gold))
    words = fillers or ["word"]
    while len(out) < n:
        text, gold = "", []
        for _ in range(rng.randint(1, 3)):
            text += " ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) + rng.choice([" ", " ", ": ", "\n"])
            kind, s = made_up(rng)
            if kind:
                gold.append((kind, len(text), len(text) + len(s)))
            text += s + rng.choice([" ", " ", ". ", ", ", "\n"])
        out.append((text, gold))
    return out


def train(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """Learns from made-up items, and from base matches in at most STRETCHES stretches of some ``sample`` texts.

    The texts are a share of hashed ids and are searched whole, by the tasks; of all their stretches, and of one in 50 of
    their words, those of smallest hash come to the driver.
    """
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = hashed_share(rows, "doc_id", docs.count(), sample).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                out += [("stretch", p) for p in pieces_of(text) if len(p) <= 4 * PIECE]
                out += [("filler", w) for w in text.split()[::50] if len(w) <= MOST_CHARS and not _trigger.search(w)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.string())], names=["what", "part"])

    parts = rows.mapInArrow(run, "what string, part string").distinct()
    found = {what: [r["part"] for r in parts.where(F.col("what") == what).orderBy(F.xxhash64("part"), "part").limit(n).collect()] for what, n in (("stretch", STRETCHES), ("filler", FILLERS))}
    field = Field()
    field.learn(training_set(found["stretch"], found["filler"]))
    return field


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def all_spans(field: Field, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Base spans, and the field's spans that overlap none of them."""
    more = [s for a, b in regions(text) for s in field.decode(text, a, b) if not any(x < s[2] and s[1] < y for _, x, y in base)] if _trigger.search(text) else []
    return sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_personal_data(docs: DataFrame, sample: int = SAMPLE, field: Field | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for each row of ``docs``.

    The counts and the digest are of base spans; ``spans`` holds these and those the random field adds, of which there
    are n_added. Offsets are code points, ends exclusive. One pass without a shuffle; the field, some thousand weights,
    is broadcast. A null text is empty and has no spans. Rows without an id or with a repeated one are treated alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field or train(docs, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                base = base_spans(text)
                every = all_spans(shared.value, text, base)
                n = [sum(k == kind for k, *_ in base) for kind in KINDS]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(read(spark, sf_dir, "documents"))
