"""N-gram Jaccard join by token-combination prefixes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, least_reachable, mix, read, release, salted_join, slices, stored, swept, text_or_empty, word_hashes

STEP = np.uint64(0x9E3779B97F4A7C15)
#: Tokens and texts of a chunk, tokens of a bucket: what one task holds at a time.
CHUNK_TOKENS, CHUNK_TEXTS, BUCKET_TOKENS = 2_000_000, 60_000, 2_000_000
#: In place of a text's number: the token stands in several sets of its chunk; the text is not counted.
MANY = NONE = 0xFFFF
BROADCAST_ROWS = 200_000
#: Frequency classes of tokens, see ``frequency_class``: up to RARE they are indexed singly, up to MIDDLE in twos.
RARE, MIDDLE = 3, 7
#: Nodes and tokens of a ball that one task compares in memory; tokens that it compares at a time.
BALL_NODES, BALL_TOKENS, COLUMNS = 1024, 500_000, 4096


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's runs of ``width`` words; of fewer words, the hash of all."""
    word, ends = word_hashes(texts)
    out = []
    with np.errstate(over="ignore"):
        runs = word.copy()
        for k in range(1, width):
            runs = runs[:-1] * STEP + word[k:] if len(runs) > 1 else runs[:0]
        runs = mix(runs)
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            if b - a >= width:
                out.append(np.unique(runs[a : b - width + 1]))
            elif b > a:
                h = np.uint64(b - a)
                for w in word[a:b]:
                    h = mix(h * STEP + w)
                out.append(np.array([h]))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def digest_of(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def pack(tokens: np.ndarray, values: np.ndarray) -> bytes:
    """Rising 64-bit numbers and a 16-bit value for each: differences and values by byte planes, compressed."""
    steps = np.diff(tokens).astype("<u8")
    width = (int(steps.max()).bit_length() + 7) // 8 if len(steps) else 0
    planes = steps.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    values = values.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<IBQ", len(tokens), width, int(tokens[0])) + planes + values)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, width, first = struct.unpack_from("<IBQ", raw)
    at = struct.calcsize("<IBQ")
    steps = np.zeros((n - 1, 8), np.uint8)
    steps[:, :width] = np.frombuffer(raw, np.uint8, (n - 1) * width, at).reshape(width, n - 1).T
    values = np.frombuffer(raw, np.uint8, 2 * n, at + (n - 1) * width).reshape(2, n).T.copy().view("<u2").ravel()
    with np.errstate(over="ignore"):
        tokens = np.cumsum(np.append(np.uint64(first), steps.view("<u8").ravel()), dtype=np.uint64)
    return tokens, values


def by_bucket(tokens: np.ndarray, values: np.ndarray, bits: int, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Packed parts of rising ``bits``-bit tokens; buckets are ranges, so the parts in their order are the whole list."""
    top = tokens >> np.uint64(max(0, bits - 32))
    at, start = np.unique(top * np.uint64(buckets) >> np.uint64(min(bits, 32)), return_index=True)
    for i, a, b in zip(at, start, [*start[1:], len(tokens)], strict=True):
        yield int(i), pack(tokens[a:b], values[a:b])


def counted_texts(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, digest, own): set size, digest of the set, and how many of its tokens are in no other set, at most.

    A chunk, the texts that a task has read up to CHUNK_TOKENS tokens, names each of its distinct tokens once, with the
    number of its text, or with MANY where several texts with different sets have it. Buckets, ranges of tokens, tell the
    chunks how many tokens of each text nobody else has named. Tokens are cut to some bits more than tell all tokens
    apart: where two are taken for one, ``own`` is too small, which adds work and never hides a link. So the commonest
    token is named once a chunk, and a text once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    bits = min(48, max(32, (size // 2).bit_length() + 8))
    buckets = slices(spark, size // 6 // BUCKET_TOKENS + 1)
    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("texts", pa.binary()), ("tokens", pa.binary())])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        ids, sizes, digests, places, sets, seen, held = [], [], [], [], [], {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, held
            name = (part << 24) | number
            number += 1
            named = np.array([x is not None for x in ids])
            texts = struct.pack("<I", len(ids)) + np.array([x or 0 for x in ids], "<i8").tobytes() + named.tobytes() + np.array(sizes, "<i8").tobytes() + np.array(places, "<u2").tobytes() + b"".join(digests)
            out = [(-1 - name % buckets, name, texts, None)]
            if sets:
                own = np.repeat(np.arange(len(sets), dtype=np.uint64), [len(s) for s in sets])
                both = np.sort((np.concatenate(sets) >> np.uint64(64 - bits) << np.uint64(16)) | own)
                token = both >> np.uint64(16)
                first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
                place = (both[first] & np.uint64(0xFFFF)).astype(np.uint16)
                place[np.diff(np.append(first, len(token))) > 1] = MANY
                out += [(i, name, None, blob) for i, blob in by_bucket(token[first], place, bits, buckets)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
            for x in (ids, sizes, digests, places, sets, seen):
                x.clear()
            held = 0

        for b in batches:
            for doc, s in zip(b.column("doc_id").to_pylist(), shingle_sets(b.column("text").to_pylist(), width), strict=True):
                digest, place = digest_of(s), NONE
                if len(s) and doc is not None:
                    if (place := seen.get(digest, NONE)) == NONE:
                        place = seen[digest] = len(sets)
                        sets.append(s)
                        held += len(s)
                ids.append(doc)
                sizes.append(len(s))
                digests.append(digest)
                places.append(place)
                if held >= CHUNK_TOKENS or len(ids) >= CHUNK_TEXTS:
                    yield from flush()
        if ids:
            yield from flush()

    def alone(key, rows: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            return rows[["chunk", "texts"]].assign(counts=None)
        parts = [unpack(x) for x in rows["tokens"]]
        token, n = np.unique(np.concatenate([t for t, _ in parts]), return_counts=True)
        out = []
        for chunk, (t, place) in zip(rows["chunk"], parts, strict=True):
            mine = place[(place != MANY) & (n[np.searchsorted(token, t)] == 1)]
            if len(mine):
                out.append((chunk, None, zstandard.ZstdCompressor(level=1).compress(np.bincount(mine).astype("<u4").tobytes())))
        return pd.DataFrame(out, columns=["chunk", "texts", "counts"])

    def summed(key, rows: pd.DataFrame) -> pd.DataFrame:
        raw = rows["texts"].dropna().iloc[0]
        n = struct.unpack_from("<I", raw)[0]
        ids = pd.Series(np.frombuffer(raw, "<i8", n, 4), dtype="Int64").where(np.frombuffer(raw, bool, n, 4 + 8 * n))
        place = np.frombuffer(raw, "<u2", n, 4 + 17 * n)
        total = np.zeros(NONE + 1, np.int64)
        for blob in rows["counts"].dropna():
            counts = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "<u4")
            total[: len(counts)] += counts
        total[NONE] = 0
        digests = raw[4 + 19 * n :]
        return pd.DataFrame({"doc_id": ids, "n": np.frombuffer(raw, "<i8", n, 4 + 9 * n), "digest": [digests[16 * i : 16 * i + 16] for i in range(n)], "own": total[place]})

    asked = rows.mapInArrow(chunks, "bucket int, chunk long, texts binary, tokens binary")
    answers = asked.groupBy("bucket").applyInPandas(alone, "chunk long, texts binary, counts binary")
    return stored(answers.groupBy("chunk").applyInPandas(summed, "doc_id long, n long, digest binary, own long"), "texts")


def sets_of(docs: DataFrame, alive: DataFrame, width: int) -> DataFrame:
    """(chunk, nodes, sizes, tokens): the sets of the nodes in ``alive`` (node, doc_id, digest), some at a time."""
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    wanted = F.broadcast(alive) if alive.count() <= BROADCAST_ROWS else alive
    schema = pa.schema([("chunk", pa.int64()), ("nodes", pa.binary()), ("sizes", pa.binary()), ("tokens", pa.binary())])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held = TaskContext.get().partitionId(), 0, {}

        def flush() -> pa.RecordBatch:
            cells = [(part << 24) | number, np.array(list(held), "<i8").tobytes(), np.array([len(s) for s in held.values()], "<i8").tobytes(), np.concatenate(list(held.values())).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, schema.types, strict=True)], schema=schema)

        for b in batches:
            for node, digest, s in zip(b.column("node").to_pylist(), b.column("digest").to_pylist(), shingle_sets(b.column("text").to_pylist(), width), strict=True):
                if digest_of(s) == digest:
                    held[node] = s
            if sum(map(len, held.values())) >= CHUNK_TOKENS // 4:
                yield flush()
                held, number = {}, number + 1
        if held:
            yield flush()

    picked = rows.join(wanted.select("node", "doc_id", "digest"), "doc_id").select("node", "digest", "text")
    return stored(picked.mapInArrow(chunks, "chunk long, nodes binary, sizes binary, tokens binary"), "sets")


def frequency_class(n: np.ndarray) -> np.ndarray:
    """1, 2 and 3 for as many sets; 4 for 4 to 7, 5 for 8 to 15 and so on."""
    return np.where(n < 4, n, 2 + np.floor(np.log2(np.maximum(n, 4)))).astype(np.uint8)


def missing(n: int, percent: int) -> int:
    """How many tokens of a set of n any set that it links with can lack."""
    return (100 - percent) * n // 100


def run_length(k: int, n: int, own: int, percent: int) -> int:
    """Tokens of the extended prefix that leaves one common combination of ``k`` tokens, see ``signatures``."""
    lack = (100 - percent) * n - 100 * own
    return max(k * lack // 100, (k - 1) * lack // percent) + k


def combinations(tokens: np.ndarray, k: int, kind: int) -> np.ndarray:
    if len(tokens) < k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(len(tokens) - k + 1, kind, np.uint64)
        for i in range(k):
            h = mix(h * STEP + tokens[i : len(tokens) - k + 1 + i])
    return h


def signatures(n: int, own: int, tokens: np.ndarray, classes: np.ndarray, percent: int) -> np.ndarray:
    """What a set of n is indexed by: of two sets that link, one signature at least is in both.

    ``own`` of its tokens are in no other set; the others are ordered by frequency class, then hash, rarest first, which
    is one order for all sets. The set lacks at most m - own of these in a set that it links with. So the first token that
    two sets have in common is among the first m - own + 1 of either, their prefixes.
    - Rare tokens of the prefix are indexed singly. That covers each pair one of whose prefixes holds rare ones only.
    - Other sets extend the prefix and index each combination of k tokens that follow one another. Each token that x alone
      has breaks at most k of x's combinations, and each that y alone has k - 1; of a prefix of ``run_length`` tokens one
      combination is left that both have, and it is in both prefixes, as that of the prefix that ends first.
    - k is 2 for combinations whose tokens are of middle frequency at most. That covers each pair one of whose extended
      prefixes holds no commoner ones.
    - Sets left index combinations of 4 tokens, however common, or of 2 where so long a prefix doesn't fit into the set.
      Sizes around that border index both, so that of two sets that can link both have one kind in common.
    """
    need = missing(n, percent) - own + 1
    first = classes[:need]
    out = [combinations(tokens[:need][first <= RARE], 1, 1)]
    if (first > RARE).any():
        length = run_length(2, n, own, percent)
        middle = tokens[:length][classes[:length] <= MIDDLE]
        out.append(combinations(middle, 2, 2))
        if (classes[:length] > MIDDLE).any():
            border = -(-400 // (100 - 4 * (100 - percent)))
            if n >= border:
                out.append(combinations(tokens[: run_length(4, n, own, percent)], 4, 4))
            if n <= 100 * border // percent + 1:
                out.append(combinations(tokens[:length], 2, 3))
    return np.unique(np.concatenate(out))


def indexed(sets: DataFrame, percent: int) -> DataFrame:
    """(node, n, own, central, shared, sigs) for the nodes that can link with some other by the frequencies of their tokens.

    ``shared`` are the tokens that other sets have too, ``central`` is the mean frequency class of all tokens.
    Frequencies over all chunks are counted in buckets, as in ``counted_texts``; the answers go back to the chunks.
    """
    spark = sets.sparkSession
    size = sets.agg(F.coalesce(F.sum(F.length("tokens").cast("long")), F.lit(0))).first()[0] // 8
    buckets = slices(spark, size // BUCKET_TOKENS + 1)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, blob in zip(b.column("chunk").to_pylist(), b.column("tokens").to_pylist(), strict=True):
                token, n = np.unique(np.frombuffer(blob, "<u8"), return_counts=True)
                parts = list(by_bucket(token, np.minimum(n, 0xFFFF), 64, buckets))
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([chunk] * len(parts), pa.int64()), pa.array([x for _, x in parts], pa.binary())], names=["bucket", "chunk", "tokens"])

    def answer(key, rows: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(x) for x in rows["tokens"]]
        token, at = np.unique(np.concatenate([t for t, _ in parts]), return_inverse=True)
        kind = frequency_class(np.bincount(at, np.concatenate([n for _, n in parts]), len(token)))[at]
        ends = np.cumsum([len(t) for t, _ in parts])
        return pd.DataFrame({"bucket": key[0], "chunk": rows["chunk"], "classes": [x.tobytes() for x in np.split(kind, ends[:-1])]})

    def index(key, rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        kinds = np.frombuffer(b"".join(answers.sort_values("bucket")["classes"]), np.uint8)
        for nodes, sizes, blob in zip(rows["nodes"], rows["sizes"], rows["tokens"], strict=True):
            tokens = np.frombuffer(blob, "<u8")
            kind = kinds[np.unique(tokens, return_inverse=True)[1]]
            ends = np.append(0, np.cumsum(np.frombuffer(sizes, "<i8")))
            for node, a, b in zip(np.frombuffer(nodes, "<i8"), ends[:-1], ends[1:], strict=True):
                t, c, n = tokens[a:b], kind[a:b], int(b - a)
                own = int((c == 1).sum())
                if own > missing(n, percent):
                    continue
                central, t, c = float(c.mean()), t[c > 1], c[c > 1]
                order = np.argsort(c, kind="stable")  # tokens of a set come by hash
                out.append((node, n, own, central, t.view("<i8"), signatures(n, own, t[order], c[order], percent).view("<i8")))
        return pd.DataFrame(out, columns=["node", "n", "own", "central", "shared", "sigs"])

    asked = sets.mapInArrow(ask, "bucket int, chunk long, tokens binary")
    answers = asked.groupBy("bucket").applyInPandas(answer, "bucket int, chunk long, classes binary")
    both = sets.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return stored(both.applyInPandas(index, "node long, n long, own long, central double, shared array<long>, sigs array<long>"), "indexed")


def linked(both: Column | str, x: str, y: str, percent: int) -> Column:
    """Whether sets of sizes x and y that differ in ``both`` tokens link."""
    return (100 + percent) * both <= (100 - percent) * (F.col(x) + F.col(y))


def stars(rows: DataFrame, key: list[str], centre: Column, apart: str = "node") -> DataFrame:
    """(*key, node, hub): each row of ``rows`` (*key, node, ..) with the node of its key for which ``centre`` is largest,
    for the keys whose rows differ in the column ``apart``."""
    hubs = rows.groupBy(*key).agg(F.max(F.struct(centre, "node")).alias("hub"), F.min(apart).alias("lo"), F.max(apart).alias("hi")).where("lo != hi")
    return rows.select(*key, "node").join(hubs.select(*key, F.col("hub.node").alias("hub")), key).where("node != hub")


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, component) after the components of the stored table ``links`` (component a, component b) were joined."""
    if links.isEmpty():
        return labels
    merged = components(links).toDF("component", "to")
    return stored(labels.join(merged, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")


def candidates(balls: DataFrame, percent: int) -> DataFrame:
    """What of ``balls`` (ball, node, component, n, own, d) can link with a node of the same ball and another component.

    The sets x and y of a ball are given as what they differ in from one centre, own tokens apart: x and y differ in
    own_x + own_y + |d_x ^ d_y| tokens. What of d_x is in no d_y of another component is added to own_x. If s_x of d_x is
    left, |d_x ^ d_y| >= |s_x - s_y|, so a link needs f_x + f_y + (1 + t) |s_x - s_y| <= 0 with f = (1 + t) own - (1 - t) n.
    For each size s a ball's least f of two components tells each x whether such a y can be. All that can't goes, which
    takes sharers away from others, and so on, as long as half of the rows go. ``least`` is the number of tokens that x
    must have in common with any such y.
    """
    each = 100 + percent
    rows, n = balls, balls.count()
    while True:  # a text that repeats with its id has been read more than once: its rows are one from here on
        cells = rows.select("ball", "node", "component", "n", (F.col("own") + F.size("d")).alias("own"), F.explode_outer("d").alias("e"))
        useful = cells.groupBy("ball", "e").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo != hi").select("ball", "e", "c")
        first = [F.first(c).alias(c) for c in ("component", "n", "own")]
        kept = cells.join(useful, ["ball", "e"], "left").groupBy("ball", "node").agg(*first, F.sort_array(F.collect_set(F.when(F.col("c").isNotNull(), F.struct("c", "e")))).alias("d"))
        kept = kept.withColumns({"s": F.size("d"), "own": F.col("own") - F.size("d")})
        kept = stored(kept.withColumn("f", each * F.col("own") - (100 - percent) * F.col("n")), "kept")
        of = kept.groupBy("ball", "s", "component").agg(F.min("f").alias("f"))
        best = of.groupBy("ball", "s").agg(F.min(F.struct("f", "component")).alias("x"))
        other = of.join(best, ["ball", "s"]).where("component != x.component").groupBy("ball", "s").agg(F.min("f").alias("g"))
        sizes = best.join(other, ["ball", "s"], "left").groupBy("ball").agg(F.collect_list(F.struct("s", "x.f", "x.component", "g")).alias("sizes"))
        mates = F.expr(f"""transform(filter(transform(sizes, z -> struct(z.s AS s, if(z.component = component, z.g, z.f) AS f)),
                           z -> z.f IS NOT NULL AND f + z.f + {each} * abs(s - z.s) <= 0), z -> f + z.f + {each} * (s + z.s))""")
        met = salted_join(kept, sizes, ["ball"], "node").withColumn("mates", mates).where("size(mates) > 0")
        least = F.greatest(F.lit(1), F.ceil(F.array_min("mates") / F.lit(2.0 * each)).cast("int"))
        out = stored(met.select("ball", "node", "component", "n", "own", F.transform("d", lambda z: z["e"]).alias("d"), least.alias("least")), "candidates")
        release(kept, *([rows] if rows is not balls else []))
        left = out.count()
        if left > 0.5 * n or not left:
            return out
        rows, n = out, left


def links_within(n: np.ndarray, own: np.ndarray, component: np.ndarray, d: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of components that lead to the same links as all links between the nodes of one ball, see ``candidates``.

    How many tokens any two of the d share is the product of their matrix, some columns at a time, with itself.
    """
    size = np.array([len(x) for x in d], np.int64)
    at, count = np.unique(np.concatenate(d), return_inverse=True, return_counts=True)[1:]
    node = np.repeat(np.arange(len(d)), size)[count[at] > 1]
    column = np.cumsum(count > 1)[at[count[at] > 1]] - 1  # tokens of one node alone are shared by none
    order = np.argsort(column, kind="stable")
    node, column = node[order], column[order]
    both = np.zeros((len(d), len(d)), np.float32)
    for first in range(0, int((count > 1).sum()), COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        block = np.zeros((len(d), COLUMNS), np.float32)
        block[node[a:b], column[a:b] - first] = 1
        both += block @ block.T
    alone = (100 + percent) * (own + size) - (100 - percent) * n
    links = alone[:, None] + alone[None] - 2 * (100 + percent) * both.astype(np.int64) <= 0
    x, y = np.nonzero(np.triu(links & (component[:, None] != component[None])))
    name, least = least_reachable(component[x], component[y])
    return name[name != least], least[name != least]


def settled_at_once(balls: DataFrame, percent: int) -> DataFrame:
    """(a, b): stored links between components, from each of ``balls`` within one task."""

    def within(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("node")
        a, b = links_within(*[rows[c].to_numpy() for c in ("n", "own", "component")], list(rows["d"]), percent)
        return pd.DataFrame({"a": a, "b": b})

    return stored(balls.groupBy("ball").applyInPandas(within, "a long, b long").distinct(), "links")


def settled(labels: DataFrame, balls: DataFrame, percent: int) -> DataFrame:
    """``labels`` with all links between nodes of one ball.

    Balls up to BALL_NODES nodes and BALL_TOKENS tokens are each compared in memory, all nodes with all. Larger ones are
    cut, by turns until no ball has nodes of two components that can link: in a turn each ball's ``candidates`` form groups
    by the rarest of the tokens in which they differ from the centre, as many as any two that link must share one of. A
    group's node nearest to the centre becomes the centre of a new ball of the group; links with it are found on the way.
    A ball loses its centre each time, so this ends; no pair is left out.
    """
    row = ["ball", "node", "n", "own", "d"]
    while True:
        sizes = balls.groupBy("ball").agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.size("d")).alias("tokens"))
        small = (F.col("nodes") <= BALL_NODES) & (F.col("tokens") <= BALL_TOKENS)
        few = balls.join(sizes.where(small), "ball", "left_semi")
        found = settled_at_once(few, percent)
        labels = joined(labels, found)
        release(found)
        many = sizes.where(~small).select("ball")
        if many.isEmpty():
            release(balls)
            return labels
        rest = opened(balls.select(*row).join(many, "ball", "left_semi"), labels)
        rows = candidates(rest, percent)
        release(balls, rest)
        if rows.isEmpty():
            release(rows)
            return labels
        tokens = rows.withColumn("e", F.explode(F.slice("d", 1, F.size("d") - F.col("least") + 1)))
        pairs = stars(tokens, ["ball", "e"], -(F.col("own") + F.size("d")), "component").select("ball", "node", "hub").distinct()
        hub = rows.select("ball", F.col("node").alias("hub"), *[F.col(c).alias(f"hub_{c}") for c in ("component", "n", "own", "d")])
        both = salted_join(pairs.join(rows.drop("least"), ["ball", "node"]), hub, ["ball", "hub"], "node")
        differ = F.array_union(F.array_except("d", "hub_d"), F.array_except("hub_d", "d"))
        both = both.withColumn("d", differ).withColumn("ball", F.concat_ws("/", "ball", "hub"))
        links = linked(F.col("own") + F.col("hub_own") + F.size("d"), "n", "hub_n", percent) & (F.col("component") != F.col("hub_component"))
        met = stored(both.select(*row, "component", "hub_component", links.alias("links")), "met")
        found = stored(met.where("links").select(F.col("component").alias("a"), F.col("hub_component").alias("b")).distinct(), "links")
        labels = joined(labels, found)
        balls = opened(met.select(*row), labels)
        release(rows, met, found)


def opened(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The balls of ``rows`` whose nodes are of two components or more, with the components."""
    at = rows.join(labels, "node")
    mixed = at.groupBy("ball").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("ball")
    return stored(at.join(mixed, "ball", "left_semi"), "balls")


def link(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``.

    Two documents link when 100 times the size of the intersection of their sets of ``width``-word shingles is at least
    ``percent`` (80 to 99) times that of the union. Words are runs of other characters than blank and \\t to \\r, A-Z
    lower-cased; a text of fewer words is one shingle. component_id is the smallest doc_id that links lead to. Texts that
    are null, empty or blank have no shingles and link with nothing: their component is their own id. Rows without an id
    take no part: their component is null. Rows that repeat an id are each linked by their own text. An empty table gives
    an empty result; other columns are not read, and texts are never cut.

    Rows with equal sets are one node. Nodes of which more tokens than a link allows are in no other set end here. The
    others are indexed by ``signatures``. Nodes of one signature are compared with the most central of them, exactly,
    and form a ball around it; what is still open inside a ball is left to ``settled``. So a group of n copies gives some
    n pairs, not n squared; only balls of bounded size are compared all with all, each within one task.
    """
    if not 80 <= percent < 100:
        raise ValueError("percent must be from 80 to 99")
    spark = docs.sparkSession
    texts = counted_texts(docs, width)
    swept(spark)
    nodes = texts.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.min("own").alias("own"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    alive = nodes.where(f"100 * own <= {100 - percent} * n AND n > 1")
    sets = sets_of(docs, alive, width)
    index = indexed(sets, percent)
    release(sets)
    swept(spark)

    members = index.select("node", "central", F.explode("sigs").alias("sig"))
    pairs = stored(stars(members, ["sig"], F.col("central")).select("node", "hub").distinct(), "pairs")
    one = index.select("node", "n", "own", "shared")
    hub = one.select(*[F.col(c).alias(x) for c, x in (("node", "hub"), ("n", "hub_n"), ("own", "hub_own"), ("shared", "hub_shared"))])
    both = pairs.join(one, "node").join(hub, "hub")
    fits = (100 * F.col("n") >= percent * F.col("hub_n")) & (100 * F.col("hub_n") >= percent * F.col("n"))
    differ = F.col("n") + F.col("hub_n") - 2 * F.size(F.array_intersect("shared", "hub_shared"))
    found = stored(both.where(fits).where(linked(differ, "n", "hub_n", percent)).select(F.col("node").alias("a"), F.col("hub").alias("b")), "links")
    labels = joined(alive.select("node", F.col("node").alias("component")), found)
    open_ = opened(pairs.select(F.col("hub").cast("string").alias("ball"), "node"), labels)
    spread = open_.join(one, "node").withColumn("hub", F.col("ball").cast("long")).join(hub.select("hub", "hub_shared"), "hub")
    spread = spread.select("ball", "node", "component", "n", "own", F.array_union(F.array_except("shared", "hub_shared"), F.array_except("hub_shared", "shared")).alias("d"))
    labels = settled(labels, stored(spread, "balls"), percent)

    at = nodes.join(labels, "node", "left").select("digest", "doc_id", F.coalesce("component", "node").alias("component"))
    least = at.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    known = stored(at.join(least, "component").select("digest", "component_id"), "known")
    release(nodes, index, pairs, found, open_)
    swept(spark)
    out = texts.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(known, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(read(spark, sf_dir, "documents"))
