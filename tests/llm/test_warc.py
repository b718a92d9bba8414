import gzip
import hashlib

import pytest

from kontrast.llm.common import new_path
from kontrast.llm.warc import read_archives, with_roles, write_archives


def trip(df):
    path = new_path(df.sparkSession, "warc-test")
    write_archives(with_roles(df), path)
    return {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read_archives(df.sparkSession, path).collect()}


def test_round_trip_with_magic_in_payloads(spark):
    fake = "a\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    big, nest = "é" * 600, fake + "WARC/1.0\r\nContent-Length: 4\r\n\r\n"
    rows = [(1, "u\r\nWARC/1.0", fake, 1), (2, None, None, 1), (3, "u", "", 1), (4, "u", big, 1), (9, "u", big, 1), (5, "u", big, 1), (6, "u", nest, 1), (None, "u", big, 1), (7, "u", "x" * 999, 1), (8, "u", "x" * 999, 1), (9, "u", big, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int")
    want = set()
    for i, _, h, _ in rows:
        p = (h or "").encode()
        re = h == big and i != 9
        want.add((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if re else "response", 9 if re else None))
    assert trip(df) == want
    assert trip(df.limit(0)) == set()


def test_ranges_of_one_file(spark):
    """A file cut into many ranges: records that cross them, magics inside payloads, whole ranges inside one payload."""
    import random

    rng = random.Random(1)
    fake = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    rows = [(i, "u", "".join(rng.choice(["x" * rng.randrange(300), fake, "WARC/1.", "é\r\n\r\n", fake[:60]]) for _ in range(rng.randrange(6)))) for i in range(300)]
    rows += [(500, "u", fake * 60), (501, "u", ("WARC/1.1\r\n" + "y" * 5000) * 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    want = {(i, len(h.encode()), hashlib.sha1(h.encode()).hexdigest(), "response", None) for i, _, h in rows}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1500", "20000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert trip(df) == want, size
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_chains_that_break_and_other_archives(spark, tmp_path):
    rec = lambda body, version=b"1.0": b"WARC/" + version + b"\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    data = rec(b"one") + rec(b"x\r\n\r\n" + rec(b"fake")[:-4], b"1.1") + rec(b"") + rec(rec(b"") * 3) + rec(bytes(range(256)))
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(rec(x)) for x in (b"1", b"22", b"WARC/1.0\r\n")))
    got = sorted((r.payload_bytes, r.payload_digest, r.record_type, r.page_id) for r in read_archives(spark, str(tmp_path)).collect())
    bodies = [b"one", b"x\r\n\r\n" + rec(b"fake")[:-4], b"", rec(b"") * 3, bytes(range(256)), b"1", b"22", b"WARC/1.0\r\n"]
    assert got == sorted((len(x), hashlib.sha1(x).hexdigest(), "resource", None) for x in bodies)
    for bad in (data[:-9], data + b"rubbish", b"rubbish" + data, data[:60] + data[61:]):
        (tmp_path / "a.warc").write_bytes(bad)
        with pytest.raises(ValueError, match="breaks off"):
            read_archives(spark, str(tmp_path))
