"""WARC archives: writing records with revisits, and reading back by boundary-chain verification."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, read, release, stored

#: Where fragments of an archive end; a record's version line begins with it.
SEP = b"WARC/1."
VERSIONS = (b"0\r\n", b"1\r\n")
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Longer headers are none.
MOST_HEAD = 1 << 16
SALTS = 16
BROADCAST_ROWS = 200_000


def with_roles(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Adds payload_bytes, payload_digest, record_type and refers_to to (page_id, url, html).

    Of rows with equal payloads (length and SHA-1) of at least ``min_bytes``, those with the largest page_id are
    responses and the others revisit it; rows without a page_id never are revisited. A null html is an empty payload.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")).withColumns(
        {"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha1(F.col("html").cast("binary"))}
    )
    key = ["payload_digest", "payload_bytes"]
    groups = rows.where(F.col("payload_bytes") >= min_bytes).groupBy(*key).agg(F.max("page_id").alias("latest"), F.count(F.lit(1)).alias("n"))
    groups = stored(groups.where("n > 1 AND latest IS NOT NULL").select(*key, "latest"), "payloads")
    if groups.count() <= BROADCAST_ROWS:
        salted = rows.join(F.broadcast(groups), key, "left")
    else:  # a payload can have very many copies: its rows are dealt over SALTS keys, and the group's one row is repeated for each
        groups = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(groups, [*key, "salt"], "left")
    revisit = F.col("latest").isNotNull() & ~F.col("latest").eqNullSafe(F.col("page_id"))
    return salted.select("page_id", "url", "html", *reversed(key), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("latest")).alias("refers_to"))


def write_archives(rows: DataFrame, path: str, date: str = "2020-01-01T00:00:00Z") -> None:
    """Writes the result of ``with_roles`` as WARC files by Spark's own text sink; ``date`` is that of all records.

    A record ends with two line ends, which is the separator that the sink puts after each row. Line ends in a URL
    become blanks. Revisits have no block; they carry the digest of the payload that they stand for. Files are not
    compressed, so that a file of any size can be read by many tasks.
    """
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    record = F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type: ", F.col("record_type")),
        line("WARC-Record-ID: ", urn("page_id")),
        line("WARC-Date: ", date),
        line("WARC-Target-URI: ", F.coalesce(F.translate("url", "\r\n", "  "), F.lit(""))),
        line("WARC-Payload-Digest: sha1:", F.col("payload_digest")),
        F.when(revisit, F.concat(line("WARC-Refers-To: ", urn("refers_to")), line("WARC-Profile: ", PROFILE))).otherwise(""),
        line("Content-Type: text/html"),
        line("Content-Length: ", F.when(revisit, "0").otherwise(F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, "").otherwise(F.col("html")),
    )
    rows.select(record.alias("value")).write.option("lineSep", END.decode()).text(path)


FIELD = re.compile(rb"(?mi)^(WARC-Type|WARC-Record-ID|WARC-Refers-To|WARC-Payload-Digest|Content-Length):[ \t]*([^\r\n]*)")


def length_of(head: bytes) -> int | None:
    """Content-Length of a header that begins after SEP; None if it is no header."""
    if not head.startswith(VERSIONS):
        return None
    found = [v for k, v in FIELD.findall(head) if k.lower() == b"content-length"]
    return int(found[0]) if found and found[0].isdigit() and len(found[0]) < 16 else None


class Fragments:
    """What one task knows of its range of a file: candidates (start, next) of fragments, counted from the range's begin.

    Fragments begin after a SEP, and positions are those of such begins: that of the record that follows one with n bytes
    of block is the end of the header + n + the closing line ends + the SEP.
    """

    def __init__(self, first: bool):
        self.at, self.candidates, self.open, self.first = 0, [], [], first

    def add(self, head: bytes, size: int, ends: bool) -> None:
        """One more fragment of ``size`` bytes; ``head`` is what stands before its first blank line, if it has one (``ends``)."""
        if not self.first:
            self.open.append((self.at, b""))  # what stands before the first SEP of a file is no record
        still = []
        for start, before in self.open:
            whole = before + (SEP if before else b"") + head
            if ends:
                if (n := length_of(whole)) is not None:
                    self.candidates.append((start, start + len(whole) + len(END) + n + len(END) + len(SEP)))
            elif whole.startswith(VERSIONS) and len(whole) <= MOST_HEAD:
                still.append((start, whole))  # a SEP inside a header
        self.open = still
        self.first = False
        self.at += size + len(SEP)

    def exits(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts of candidates and where their chains leave the range, by pointer jumping; -1 where a chain breaks off."""
        start, nxt = (np.array(x, np.int64) for x in (zip(*sorted(self.candidates), strict=True) if self.candidates else ([], [])))
        n = len(start)
        jump = np.searchsorted(start, nxt)
        hit = jump < n
        hit[hit] = start[jump[hit]] == nxt[hit]
        jump = np.where(hit, jump, np.arange(n))  # the last candidate of a chain leads to itself
        for _ in range(max(1, n).bit_length()):
            jump = jump[jump]
        return start, np.where(nxt[jump] >= self.at, nxt[jump], -1)


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): archives cut at each SEP, in the order of the file within each range that a task reads."""
    rows = spark.read.option("lineSep", SEP.decode()).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def chain(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, base, entry): where each range begins, and the first record of the file's chain in it.

    1. Each task emits its candidates with the position where the chain of successors leaves its range.
    2. The ranges' lengths, summed up over a file, give whole offsets.
    3. Candidates of different ranges are joined by file and offset where one's chain enters the other's range; pointer
       jumping over these, from the file's start, finds the entries that are reached, in as many rounds as the number of
       ranges of a file has binary digits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None

        def done() -> pa.RecordBatch:
            start, out = state.exits()
            cols = [pa.array([name[0]] * (len(start) + 1)), pa.array([name[1]] * (len(start) + 1), pa.int64()), pa.array(np.append(-1, start)), pa.array(np.append(state.at, out))]
            return pa.RecordBatch.from_arrays(cols, names=["file", "block", "start", "next"])

        for b in batches:
            for file, block, head, size, ends in zip(*(b.column(c).to_pylist() for c in ("file", "block", "head", "size", "ends")), strict=True):
                if (file, block) != name:
                    if name:
                        yield done()
                    name, state = (file, block), Fragments(block == 0)
                state.add(head, size, ends)
        if name:
            yield done()

    rows = fragments(spark, path).withColumn("text", F.col("value").cast("string"))
    rows = rows.select("file", "block", F.substring_index("text", END.decode(), 1).cast("binary").alias("head"), F.octet_length("value").alias("size"))
    rows = rows.withColumn("ends", F.octet_length("head") < F.col("size"))
    links = stored(rows.mapInArrow(run, "file string, block long, start long, next long"), "links")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("next").over(before), F.lit(0))
    ranges = stored(links.where("start < 0").select("file", "block", "next", base.alias("base")).withColumnRenamed("next", "size"), "ranges")
    nodes = links.where("start >= 0 AND next >= 0").join(ranges, ["file", "block"]).select("file", (F.col("base") + F.col("start")).alias("at"), (F.col("base") + F.col("next")).alias("next"))
    ends = ranges.groupBy("file").agg(F.sum("size").alias("end"))
    reached = ends.select("file", F.lit(len(SEP)).cast("long").alias("at"))
    targets = nodes.select("file", F.col("next").alias("at")).union(reached).distinct()
    jumps = stored(targets.join(nodes, ["file", "at"]), "jumps")
    reached, count = stored(reached, "reached"), 0
    while (now := reached.count()) > count:
        count = now
        further = reached.union(reached.join(jumps, ["file", "at"]).select("file", F.col("next").alias("at"))).distinct()
        twice = jumps.join(jumps.select("file", F.col("at").alias("next"), F.col("next").alias("then")), ["file", "next"], "left").select("file", "at", F.coalesce("then", "next").alias("next"))
        further, twice = stored(further, "reached"), stored(twice, "jumps")
        release(reached, jumps)
        reached, jumps = further, twice
    broken = ends.join(reached.withColumnRenamed("at", "end"), ["file", "end"], "left_anti").limit(1).collect()
    if broken:
        raise ValueError(f"the chain of records breaks off before the end of {broken[0]['file']}")
    inside = ranges.join(reached, "file").where("at >= base AND at < base + size").groupBy("file", "block").agg(F.min("at").alias("entry"))
    entries = stored(ranges.join(inside, ["file", "block"], "left").select("file", "block", "base", "entry"), "entries")
    release(links, ranges, reached, jumps)
    return entries


OUT = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
PIECE = "file string, at long, head binary, body binary"


def fields_of(head: bytes) -> tuple:
    """(page_id, payload digest, record type, refers to) of a header; ids that aren't of pages are None."""
    found = {k.lower(): v for k, v in reversed(FIELD.findall(head))}
    ident = lambda k: int(m[1]) if (m := re.fullmatch(rb"<urn:page:(-?\d+)>", found.get(k, b"").strip())) else None
    return ident(b"warc-record-id"), found.get(b"warc-payload-digest", b"").decode("latin-1").removeprefix("sha1:") or None, found.get(b"warc-type", b"").decode("latin-1"), ident(b"warc-refers-to")


def record(head: bytes, size: int, digest: str) -> tuple:
    page, told, kind, refers = fields_of(head)
    return (page, None, told, kind, refers) if kind == "revisit" else (page, size, digest, kind, refers)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record of the archives under ``path``.

    Files are read in ranges, by as many tasks as Spark cuts them into (compressed ones, which the reader opens by their
    name's end, as a whole). ``chain`` finds out which candidates the chain from the file's start reaches, so a magic
    inside a payload is no record. A second pass walks along the reached records only and takes the SHA-1 of each payload.
    A record that goes beyond its range because its payload holds a magic leaves pieces, which are put together. The
    length of a revisit's payload is that of the response it refers to; null if there is none. Records whose id isn't that
    of a page have a null page_id. A broken chain raises an error; so does a header that holds a magic just where a range
    ends. No file at all gives an empty result. For the second pass one row for each range is broadcast, some 100 bytes
    for each 128 MB of archive.
    """
    entries = chain(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, walk, rows = None, None, []
        for b in batches:
            for file, block, base, entry, value in zip(*(b.column(c).to_pylist() for c in ("file", "block", "base", "entry", "value")), strict=True):
                if (file, block) != name:
                    if walk:
                        rows += walk.end()
                    name, walk = (file, block), Walk(file, base, entry)
                rows += walk.add(value)
            yield batch_of(rows)
            rows = []
        if walk:
            yield batch_of(walk.end())

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 9, kinds, strict=True)], names=[*OUT, "file", "at", "head", "body"])

    def put_together(rows: pd.DataFrame) -> pd.DataFrame:
        out, head, body = [], None, []

        def finish() -> None:
            n = length_of(head)
            whole = b"".join(body)[:n]
            if len(whole) < n:
                raise ValueError("a record lacks the end of its payload")
            out.append(record(head, n, hashlib.sha1(whole).hexdigest()))

        for r in rows.sort_values("at").itertuples():
            if r.head is not None:
                if head is not None:
                    finish()
                head, body = r.head, []
            body.append(r.body)
        if head is not None:
            finish()
        return pd.DataFrame(out, columns=OUT).astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})

    fields = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    walked = fragments(spark, path).join(F.broadcast(entries), ["file", "block"]).select("file", "block", "base", "entry", "value")
    found = stored(walked.mapInArrow(run, f"{fields}, {PIECE}"), "records")
    pieces = found.where("file IS NOT NULL").select("file", "at", "head", "body")
    records = found.where("file IS NULL").select(*OUT)
    if not pieces.isEmpty():
        # at most one record for each end of a range
        records = records.unionByName(pieces.groupBy("file").applyInPandas(put_together, fields))
    release(entries)
    first = records.where("record_type != 'revisit' AND page_id IS NOT NULL").groupBy("page_id").agg(F.max("payload_bytes").alias("n"))
    wanted = records.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id")).distinct()
    sizes = first.join(wanted, "page_id").select(F.col("page_id").alias("refers_to"), "n")
    known = records.where("record_type = 'revisit'").join(sizes, "refers_to", "left").select("page_id", F.col("n").alias("payload_bytes"), *OUT[2:])
    return records.where("record_type != 'revisit'").unionByName(known)


class Walk:
    """Goes along the reached records of one range and gives rows of results, or of pieces at its two ends."""

    def __init__(self, file: str, at: int, entry: int | None):
        self.file, self.at, self.expected = file, at, entry
        self.head, self.start, self.body, self.left = None, 0, [], 0  # of a record whose payload goes on

    def add(self, value: bytes) -> list[tuple]:
        out: list[tuple] = []
        if self.at == self.expected:
            self.start, self.head, self.left = self.at, b"", None
            out = self.begin(value)
        elif self.head is not None and self.left is None:
            out = self.begin(SEP + value)  # a magic inside a header
        elif self.head is not None and self.left:
            out = self.more(SEP + value)
        elif self.expected is None or (self.head is None and self.at < self.expected):
            if self.at > 0 or value:
                out = [(None,) * 5 + (self.file, self.at, None, SEP + value)]
        self.at += len(value) + len(SEP)
        return out

    def begin(self, value: bytes) -> list[tuple]:
        self.head += value
        end = self.head.find(END)
        if end < 0:
            return []
        self.head, rest = self.head[:end], self.head[end + len(END) :]
        n = length_of(self.head)
        self.expected = self.start + end + 2 * len(END) + n + len(SEP)
        self.body, self.left = [], n
        return self.more(rest) if n else [self.finished()]

    def more(self, value: bytes) -> list[tuple]:
        value = value[: self.left]
        self.body.append(value)
        self.left -= len(value)
        return [] if self.left else [self.finished()]

    def finished(self) -> tuple:
        sha = hashlib.sha1()
        for x in self.body:
            sha.update(x)
        out = (*record(self.head, sum(map(len, self.body)), sha.hexdigest()), None, None, None, None)
        self.head, self.body = b"", []
        return out

    def end(self) -> list[tuple]:
        if self.head and self.left is None:
            raise ValueError(f"a header holds a magic where a range of {self.file} ends")
        return [(None,) * 5 + (self.file, self.start, self.head, b"".join(self.body))] if self.head and self.left else []


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(with_roles(read(spark, sf_dir, "pages")), path)
    return read_archives(spark, path)


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
     m AS (SELECT d, n, max(page_id) AS latest FROM p WHERE n >= 1000 GROUP BY d, n)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN m.latest IS NOT NULL AND m.latest IS DISTINCT FROM p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m.latest IS NOT NULL AND m.latest IS DISTINCT FROM p.page_id THEN m.latest END AS refers_to
FROM p LEFT JOIN m ON p.d = m.d AND p.n = m.n
"""
