"""Language-model scores by Brown class-based bigrams, with classes from exchange clustering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, release, slices, stored, swept, text_or_empty, word_hashes

#: The commonest words, whose classes are exchanged one by one and start those of all others.
TOP = 1024
CLASSES = 64
SWEEPS = 4
PASSES = 3
CHUNK_WORDS = 3_000_000
BUCKET_WORDS = 500_000
SMOOTHING = 64.0
#: The token that ends each text; no word has this hash but by a chance of one in 2**64.
END = np.uint64(0)
#: After the clustered classes: words unknown or not yet in a class, the end.
UNKNOWN, LAST = CLASSES, CLASSES + 1
KINDS = LAST + 1
#: Added to the class of words that passes may move.
MOVES = np.uint8(128)
#: What is kept by bucket, a range of hashes: words of a chunk, entries of a chunk, answers to it; the vocabulary.
PARTS = "bucket int, chunk long, what string, a binary, b binary, c binary"


def encoded(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts as word numbers within chunks: (chunk, doc_id, held_out, tokens) and (chunk, hashes, n), and the stored table
    of both.

    A chunk is what one task reads, up to about CHUNK_WORDS words; its words are numbered by hash, n counts each in the
    chunk's training texts. The token list of a text ends with END.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, chunk, held = TaskContext.get().partitionId(), 0, []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [x for x, *_ in held]
            word = np.concatenate([w for _, w, _ in held])
            ends = np.cumsum([0] + [len(w) for _, w, _ in held])
            distinct, at = np.unique(word, return_inverse=True)
            trains = np.repeat([t for *_, t in held], np.diff(ends))
            n = np.bincount(at[trains], minlength=len(distinct))
            name = (part << 24) | chunk
            at = at.astype("<u4")
            ids, outs = zip(*rows, strict=True)
            tokens = [at[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield batch([name] * len(rows), ids, outs, tokens, None)
            yield batch([name], [None], [None], [distinct.astype("<u8").tobytes()], [n.astype("<i8").tobytes()])

        total = 0
        for b in batches:
            word, ends = word_hashes(b.column("text").to_pylist())
            for i, (doc, out, trains) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("held_out").to_pylist(), b.column("trains").to_pylist(), strict=True)):
                own = np.append(word[ends[i] : ends[i + 1]], END)
                held.append(((doc, out), own, trains))
                total += len(own)
                if total >= CHUNK_WORDS:
                    yield from flush()
                    held.clear()
                    total, chunk = 0, chunk + 1
        if held:
            yield from flush()

    def batch(chunks, ids, outs, tokens, n) -> pa.RecordBatch:
        cols = [pa.array(chunks, pa.int64()), pa.array(ids, pa.int64()), pa.array(outs, pa.bool_()), pa.array(tokens, pa.binary()), pa.array(n or [None] * len(chunks), pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=["chunk", "doc_id", "held_out", "tokens", "n"])

    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).select("doc_id", "text", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), F.coalesce(rest != 2, F.lit(False)).alias("trains"))
    # Written once: a chunk's number means nothing beyond this table.
    both = stored(rows.mapInArrow(run, "chunk long, doc_id long, held_out boolean, tokens binary, n binary"), "encoded")
    return both.where("n IS NULL").drop("n"), both.where("n IS NOT NULL").select("chunk", F.col("tokens").alias("hashes"), "n"), both


def pair_counts(docs: DataFrame, top: np.ndarray) -> np.ndarray:
    """Training counts of neighbouring pairs among the TOP commonest words, all others as one, and the end.

    At most (TOP + 2) squared numbers, whatever the input; ``top`` holds the hashes of the TOP words in order.
    """
    order = np.argsort(top)
    side = len(top) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def merged() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate(kept), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], names=["code", "n"])

        size = 0
        for b in batches:
            word, ends = word_hashes(b.column("text").to_pylist())
            word = np.insert(word, ends[1:], END)
            at = np.minimum(np.searchsorted(top[order], word), max(0, len(top) - 1))
            ids = np.where(top[order][at] == word, order[at], side - 2) if len(top) else np.full(len(word), side - 2)
            ids[word == END] = side - 1
            before = np.append(side - 1, ids[:-1])
            kept.append(before * side + ids)
            size += len(ids)
            if size > 4_000_000:
                yield merged()
                kept, size = [], 0
        if kept:
            yield merged()

    trains = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    rows = docs.where(trains).select(text_or_empty().alias("text")).mapInArrow(run, "code long, n long")
    found = rows.groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(side * side)
    out[found["code"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(side, side)


def exchange(n: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """A class for each but the last two rows of a matrix of pair counts, by exchange clustering.

    Words start in classes by turns, commonest first. Each sweep moves each word to the class that raises the training
    likelihood of the class bigram model most, that is the sum of N(a, b) log N(a, b) less twice that of N(a) log N(a).
    The last two rows (other words, the end) are classes of their own.
    """
    words = len(n) - 2
    own = np.append(np.arange(words) % classes, [classes, classes + 1])
    k = classes + 2
    right = np.zeros((len(n), k))  # counts of a word followed by a class
    left = np.zeros((k, len(n)))
    for c in range(k):
        right[:, c] = n[:, own == c].sum(1)
        left[c] = n[own == c].sum(0)
    pairs = np.zeros((k, k))
    np.add.at(pairs, own, right)
    size = n.sum(0)
    mass = np.bincount(own, size, k)
    for _ in range(sweeps):
        moved = 0
        for w in range(words):
            if not size[w]:
                continue
            a, r, l, self_ = own[w], right[w].copy(), left[:, w].copy(), n[w, w]
            r[a] -= self_
            l[a] -= self_
            pairs[a] -= right[w]
            pairs[:, a] -= left[:, w]
            pairs[a, a] += self_
            mass[a] -= size[w]
            # what putting w into class c adds: its row, its column, where they cross, and its mass
            row = (xlog(pairs[:classes] + r) - xlog(pairs[:classes])).sum(1)
            col = (xlog(pairs[:, :classes] + l[:, None]) - xlog(pairs[:, :classes])).sum(0)
            d = np.arange(classes)
            old = pairs[d, d]
            cross = xlog(old + r[:classes] + l[:classes] + self_) - xlog(old) - (xlog(old + r[:classes]) - xlog(old)) - (xlog(old + l[:classes]) - xlog(old))
            gain = row + col + cross - 2 * (xlog(mass[:classes] + size[w]) - xlog(mass[:classes]))
            b = int(np.argmax(gain))
            pairs[b] += r
            pairs[:, b] += l
            pairs[b, b] += self_
            mass[b] += size[w]
            if b != a:
                moved += 1
                own[w] = b
                right[:, a] -= n[:, w]
                right[:, b] += n[:, w]
                left[a] -= n[w]
                left[b] += n[w]
        if not moved:
            break
    return own[:words]


def xlog(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def parts(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["bucket", "chunk", "what", "a", "b", "c"])


def dealt(words: DataFrame, buckets: int) -> DataFrame:
    """The words of chunks by bucket; buckets are ranges, so a chunk's parts in order of buckets are its words in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, h, n in zip(*(batch.column(x).to_pylist() for x in ("chunk", "hashes", "n")), strict=True):
                h, n = np.frombuffer(h, "<u8"), np.frombuffer(n, "<i8")
                at, start = np.unique((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), return_index=True)
                ends = [*start[1:], len(h)]
                rows = [(int(i), chunk, "words", h[x:y].tobytes(), n[x:y].tobytes(), None) for i, x, y in zip(at, start, ends, strict=True)]
                yield pa.RecordBatch.from_pandas(parts(rows), schema=pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("what", pa.string()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())]), preserve_index=False)

    return words.mapInArrow(run, PARTS)


def merged(key, rows: pd.DataFrame) -> pd.DataFrame:
    """The vocabulary of a bucket: hashes and training counts."""
    h, at = np.unique(np.concatenate([np.frombuffer(x, "<u8") for x in rows["a"]]), return_inverse=True)
    c = np.zeros(len(h), np.int64)
    np.add.at(c, at, np.concatenate([np.frombuffer(x, "<i8") for x in rows["b"]]))
    return parts([(key[0], None, "vocabulary", h.tobytes(), c.astype("<i8").tobytes(), None)])


def in_order(answers: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list]:
    """Classes and counts of a chunk's words, and (bucket, start, end) of its parts."""
    answers = answers.sort_values("bucket")
    own = [np.frombuffer(x, np.uint8) for x in answers["a"]]
    ends = np.cumsum([0] + [len(x) for x in own])
    spans = list(zip(answers["bucket"], ends[:-1], ends[1:], strict=True))
    return np.concatenate(own), np.concatenate([np.frombuffer(x, "<i8") for x in answers["b"]]), spans


def neighbours(key, docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """How often each word of a chunk that may move stands before and after each class in its training texts.

    A part of entries has the number of entries of each word, then their codes (the class, plus KINDS where it stands
    before the word) and counts. One row more, of bucket -1, has the counts of pairs of classes.
    """
    docs = docs[~docs["held_out"].astype(bool) & docs["doc_id"].notna()]
    if not len(docs) or not len(answers):
        return parts([])
    own, _, spans = in_order(answers)
    kind, moves = (own & ~MOVES).astype(np.int32), own >= MOVES
    t = np.frombuffer(b"".join(docs["tokens"]), "<u4")
    after = kind[t]
    before = np.append(LAST, after[:-1])
    pairs = np.bincount(before * KINDS + after, minlength=KINDS * KINDS)
    last, now = moves[t[:-1]], moves[t]
    # a chunk's words times the kinds mostly fit into 32 bits
    number = np.uint32 if len(own) * 2 * KINDS < 2**32 else np.uint64
    sides = [np.unique(w.astype(number) * number(2 * KINDS) + c.astype(number), return_counts=True) for w, c in ((t[:-1][last], after[1:][last]), (t[now], before[now] + KINDS))]
    code, n = (np.concatenate(x) for x in zip(*sides, strict=True))
    order = np.argsort(code)
    code, n = code[order].astype(np.int64), n[order]
    word = code // (2 * KINDS)
    size = np.bincount(word, minlength=len(own)).astype(np.uint8)
    code, n = (code % (2 * KINDS)).astype(np.uint8), n.astype("<u4")
    out = [(-1, key[0], "pairs", pairs.astype("<i8").tobytes(), None, None)]
    for bucket, x, y in spans:
        i, j = np.searchsorted(word, [x, y])
        out.append((bucket, key[0], "entries", size[x:y].tobytes(), code[i:j].tobytes(), n[i:j].tobytes()))
    return parts(out)


def best_classes(pairs: np.ndarray, own: np.ndarray, mass: np.ndarray, word: np.ndarray, code: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The class of each word that raises the likelihood of the class bigram model most, all other words staying.

    Entries are sorted by word, one for each word and code; the counts of a word are taken out of its own class first.
    """
    size = np.maximum(pairs.sum(0)[:CLASSES], 0)
    base = np.concatenate([pairs[:CLASSES].T, pairs[:, :CLASSES]]).astype(float)
    top = int(n.max()) + 1
    kinds, at = np.unique(code.astype(np.int64) * top + n, return_inverse=True)
    old = base[kinds // top]
    table = xlog(old + (kinds % top)[:, None]) - xlog(old)
    words, start = np.unique(word, return_index=True)
    out = own.copy()
    step = 1024
    for i in range(0, len(words), step):
        some = words[i : i + step]
        x, y = start[i], start[i + step] if i + step < len(start) else len(word)
        first = start[i : i + step] - x
        gain = np.add.reduceat(table[at[x:y]], first, axis=0)
        s, a = mass[some][:, None].astype(float), own[some].astype(np.int64)
        gain -= 2 * (xlog(size + s) - xlog(size))
        stays = a < CLASSES
        e = np.minimum(own[word[x:y]].astype(np.int64), CLASSES - 1)
        cell = base[code[x:y], e]
        held = np.add.reduceat(xlog(cell) - xlog(np.maximum(cell - n[x:y], 0)), first)
        rows, a = np.flatnonzero(stays), a[stays]
        gain[rows, a] = held[rows] - 2 * (xlog(size[a]) - xlog(np.maximum(size[a] - s[rows, 0], 0)))
        # all words of a pass would take the same empty class
        gain[:, (size == 0) & size.any()] = -np.inf
        out[some] = gain.argmax(1)
    return out


def moved(names: np.ndarray, kinds: np.ndarray, pairs: np.ndarray | None):
    """A pass over a bucket: classes of its words, by ``names`` and ``kinds`` at first, and answers to its chunks."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        by = dict(tuple(rows.groupby("what")))
        state = by["vocabulary"].iloc[0]
        h, c = np.frombuffer(state["a"], "<u8"), np.frombuffer(state["b"], "<i8")
        asked = {r.chunk: np.searchsorted(h, np.frombuffer(r.a, "<u8")) for r in by["words"].itertuples()}
        if state["c"] is None:
            own = np.where(c > 0, UNKNOWN | MOVES, UNKNOWN).astype(np.uint8)
            own[h == END] = LAST
            if len(names):
                at = np.minimum(np.searchsorted(names, h), len(names) - 1)
                own = np.where(names[at] == h, kinds[at], own).astype(np.uint8)
        else:
            own = np.frombuffer(state["c"], np.uint8).copy()
        if pairs is not None and "entries" in by:
            word, code, n = [], [], []
            for r in by["entries"].itertuples():
                word.append(np.repeat(asked[r.chunk], np.frombuffer(r.a, np.uint8)))
                code.append(np.frombuffer(r.b, np.uint8))
                n.append(np.frombuffer(r.c, "<u4"))
            one, at = np.unique(np.concatenate(word) * 2 * KINDS + np.concatenate(code), return_inverse=True)
            if len(one):
                n = np.bincount(at, np.concatenate(n)).astype(np.int64)
                moves = own >= MOVES
                own = best_classes(pairs, own & ~MOVES, c, one // (2 * KINDS), one % (2 * KINDS), n)
                own[moves] |= MOVES
        out = [(key[0], None, "vocabulary", state["a"], state["b"], own.tobytes())]
        out += [(key[0], chunk, "answers", own[at].tobytes(), c[at].astype("<i8").tobytes(), None) for chunk, at in asked.items()]
        return parts(out).astype({"chunk": "Int64"})

    return run


def summed(rows: DataFrame, column: str, n: int) -> np.ndarray:
    """The sum of packed lists of n counts; what reaches the driver is one list a task's share and then n rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.frombuffer(x, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total != 0])], names=["code", "n"])

    out = np.zeros(n)
    found = rows.select(column).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out[found["code"].to_numpy()] = found["n"].to_numpy()
    return out


def score(docs: DataFrame, top: int = TOP) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``.

    Tokens are the words of the whole text, A-Z lower-cased, and one end. Training texts are those whose crc32(doc_id
    as text) mod 7 isn't 2; rows without an id neither train nor are held out. Null and empty texts are one end.
    ``base_score`` sums log10((c + 1) / (N + V + 1)) with training counts c, N tokens and V distinct tokens.

    ``score`` is the class bigram model's: P(class | class before) P(word | class). All known words have classes of
    exchange clustering. Those of the ``top`` commonest are exchanged one by one over the counts of their neighbours in
    all training text. Then PASSES times each other word, however rare, goes to the class that raises the likelihood most
    given the classes of the pass before (ties to the smaller class). A class is divided among its words by count.
    Unknown words are one type in a class of their own, as for the base; that class is expected after another as often as
    words seen once are. Transitions are smoothed by the classes' shares. So the probabilities of all V + 1 types sum to
    1 in each context.

    Words meet texts over chunks of about three million words: each chunk asks once for each of its words, so the
    commonest word is asked for once a chunk and not once a text. The vocabulary lies in buckets, ranges of hashes whose
    number follows the chunks' words. Repeated rows are scored, and counted, each.
    """
    spark = docs.sparkSession
    texts, words, both = encoded(docs)
    asked = words.agg(F.coalesce(F.sum(F.length("hashes")), F.lit(0))).first()[0] // 8
    shares = dealt(words, slices(spark, asked // BUCKET_WORDS + 1))
    state = stored(shares.groupBy("bucket").applyInPandas(merged, PARTS), "vocabulary")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, c in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
                h, c = np.frombuffer(h, "<i8"), np.frombuffer(c, "<i8")
                seen = (c > 0) & (h != 0)
                least = np.partition(c[seen], -top)[-top] if seen.sum() > top else 1
                kept = seen & (c >= least)
                # ties at the least count stay in, and the order over all buckets decides
                yield pa.RecordBatch.from_arrays([pa.array([int(c.sum())]), pa.array([int((c > 0).sum())]), pa.array([h[kept].tolist()], pa.list_(pa.int64())), pa.array([c[kept].tolist()], pa.list_(pa.int64()))], names=["n", "v", "hash", "c"])

    found = stored(state.mapInArrow(listed, "n long, v long, hash array<long>, c array<long>"), "common")
    n_all, v_all = found.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    common = found.select(F.explode(F.arrays_zip("hash", "c")).alias("x")).select("x.hash", "x.c").orderBy(F.desc("c"), "hash").limit(top)
    best = np.array([r["hash"] for r in common.collect()], np.int64).view(np.uint64)
    cls = exchange(pair_counts(docs, best)) if len(best) else np.zeros(0, np.int64)
    order = np.argsort(best)
    names, kinds = best[order], cls[order].astype(np.uint8)

    vocabulary = state
    state = stored(vocabulary.unionByName(shares).groupBy("bucket").applyInPandas(moved(names, kinds, None), PARTS), "classes")
    release(vocabulary, found)
    for _ in range(PASSES):
        answers = state.where("what = 'answers'")
        entries = stored(texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(neighbours, PARTS), "entries")
        pairs = summed(entries.where("bucket < 0"), "a", KINDS * KINDS).reshape(KINDS, KINDS)
        all_ = state.where("what = 'vocabulary'").unionByName(shares).unionByName(entries.where("bucket >= 0"))
        after = stored(all_.groupBy("bucket").applyInPandas(moved(names, kinds, pairs), PARTS), "classes")
        release(state, entries)
        state = after
        swept(spark)

    mass = np.zeros(KINDS)

    def masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(KINDS, np.int64)
        for b in batches:
            for c, own in zip(b.column("b").to_pylist(), b.column("c").to_pylist(), strict=True):
                np.add.at(total, np.frombuffer(own, np.uint8) & ~MOVES, np.frombuffer(c, "<i8"))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(KINDS)), pa.array(total)], names=["kind", "n"])

    for r in state.where("what = 'vocabulary'").mapInArrow(masses, "kind long, n long").groupBy("kind").agg(F.sum("n").alias("n")).collect():
        mass[r["kind"]] = r["n"]

    def read_chunk(key, docs_: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        own, c, _ = in_order(answers)
        kind = (own & ~MOVES).astype(np.int64)
        once = kind + KINDS * (c == 1)
        emit = np.where(c > 0, np.log10(np.maximum(c, 1) / np.maximum(mass[kind], 1)), 0.0)
        base = np.log10((c + 1) / (n_all + v_all + 1))
        out = []
        for doc, held, blob in zip(docs_["doc_id"], docs_["held_out"], docs_["tokens"], strict=True):
            t = np.frombuffer(blob, "<u4")
            k = once[t]
            code, n = np.unique(np.append(LAST, k[:-1]) * 2 * KINDS + k, return_counts=True)
            out.append((doc, held, len(t), int((c[t] > 0).sum()), float(base[t].sum()), float(emit[t].sum()), code.astype("<u2").tobytes() + n.astype("<u4").tobytes()))
        return pd.DataFrame(out, columns=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "emission", "steps"]).astype({"doc_id": "Int64"})

    answers = state.where("what = 'answers'")
    read_ = texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(read_chunk, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, emission double, steps binary")
    read_ = stored(read_, "read")
    release(both, state)
    swept(spark)

    def steps_of(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
        m = len(blob) // 6
        return np.frombuffer(blob, "<u2", m).astype(np.int64), np.frombuffer(blob, "<u4", m, 2 * m)

    def transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4 * KINDS * KINDS, np.int64)
        for b in batches:
            for blob in b.column("steps").to_pylist():
                code, n = steps_of(blob)
                total[code] += n
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], names=["code", "n"])

    # Steps tell words seen once (classes from KINDS on) from others, as the unknown ones are expected like them.
    count = np.zeros((2 * KINDS, 2 * KINDS))
    for r in read_.where("NOT held_out AND doc_id IS NOT NULL").select("steps").mapInArrow(transitions, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        count[divmod(r["code"], 2 * KINDS)] = r["n"]
    rows = np.vstack([count[:KINDS] + count[KINDS:], count[KINDS:].sum(0)])
    seen, singly = rows[:, :KINDS] + rows[:, KINDS:], rows[:, KINDS:].sum(1)
    count = seen[:KINDS]
    count[:, UNKNOWN] = singly[:KINDS]
    count[UNKNOWN] = seen[KINDS]
    count[UNKNOWN, UNKNOWN] = singly[KINDS]
    # classes without words get no share
    used = mass > 0
    used[[UNKNOWN, LAST]] = True
    share = (count.sum(0) + 0.5 * used) / (count.sum() + 0.5 * used.sum())
    with np.errstate(divide="ignore"):
        step = np.log10((count + SMOOTHING * share) / (count.sum(1, keepdims=True) + SMOOTHING))
    step[:, ~used] = 0  # never read
    step = spark.sparkContext.broadcast(np.tile(step, (2, 2)).ravel())

    @F.pandas_udf("double")
    def walk(steps: pd.Series) -> pd.Series:
        return pd.Series([float(step.value[code] @ n) for code, n in map(steps_of, steps)], dtype="float64")

    return read_.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n_all)).cast("long").alias("train_tokens"), "base_score", (F.col("emission") + walk("steps")).alias("score"))


def op9_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))
