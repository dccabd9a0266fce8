import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import warc as W
from palimpsest.storage import fresh_path

EMBEDDED = "<p>before</p>WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nafter"
PAGES = [(1, "http://a/", "x"), (2, "http://b/", "x"), (5, "http://c/", "x"), (3, None, None), (4, "http://d/\r\nX: y", ""), (6, "http://e/", "é𝄞\n\nWARC/1.1\r\n tail"), (7, "http://f/", EMBEDDED), (8, "http://g/", EMBEDDED * 40), (9, "u", "z" * 200_000), (None, "n", "nul"), (9, "u", "z" * 200_000), (10, "h", "WARC/1.1\r\n"), (11, "i", "ends\r\n\r\nWARC/1.1\r\n")]


def brute(pages, least=0):
    largest = {}
    for p, _, h in pages:
        if p is not None:
            largest[h or ""] = max(p, largest.get(h or "", p))
    out = []
    for p, _, h in pages:
        body = (h or "").encode()
        same = sum((x[2] or "") == (h or "") for x in pages) > 1 and len(body) >= least
        top = largest.get(h or "")
        revisit = same and top is not None and p != top
        out.append((p, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(map(repr, out))


def read(spark, path):
    r = W.read_warc(spark, path)
    assert r.where("not intact").count() == 0
    return sorted(map(repr, map(tuple, r.select(F.col("id").cast("long"), "bytes", "digest", "type", F.col("refers").cast("long")).collect())))


@pytest.mark.parametrize("compression", ["gzip", "none"])
@pytest.mark.parametrize("limit", [500_000, 0])
def test_round_trip(spark, monkeypatch, compression, limit):
    monkeypatch.setattr(W, "BROADCAST_ROWS", limit)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)
    path = fresh_path(spark, "warc-test")
    W.write_warc(pages, path, compression=compression)
    assert read(spark, path) == brute(PAGES)


def test_files_split_anywhere(spark):
    """Records, magic and embedded records across split boundaries."""
    some = [r for r in PAGES if len(r[2] or "") < 10_000]
    pages = spark.createDataFrame(some + [(100 + i, f"http://p/{i}", f"{i} " * (i % 50) + (EMBEDDED if i % 7 == 0 else "")) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    path = fresh_path(spark, "warc-test")
    W.write_warc(pages, path, compression="none")
    want = brute([tuple(r) for r in pages.collect()])
    for size in (2003, 20011):
        r = W.read_warc(spark, path, range_bytes=size)
        assert sorted(map(repr, map(tuple, r.select(F.col("id").cast("long"), "bytes", "digest", "type", F.col("refers").cast("long")).collect()))) == want


def test_the_query_jumps(spark, monkeypatch):
    """The registered query's own archives have several ranges a file, and pointer jumping finds the entries of all but the first."""
    from palimpsest.llm import queries

    seen, reached = [], W._reached
    monkeypatch.setattr(W, "_reached", lambda candidates, longest: seen.append((longest, out := reached(candidates, longest))) or out)
    data = "/root/testdata/sf0.01"
    rows = queries.op7_warc(spark, data)
    assert rows.count() == spark.read.parquet(f"{data}/pages.parquet").count()
    (longest, entries), = seen
    assert longest >= 4 and entries.groupBy("file").count().agg(F.max("count")).first()[0] >= 4


def _archive(tmp_path, name, *versions, head=b""):
    out = head
    for i, version in enumerate(versions):
        block = b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc"
        digest = base64.b32encode(hashlib.sha1(b"abc").digest())
        out += b"WARC/" + version + b"\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n" % (i, digest, len(block)) + block + b"\r\n\r\n"
    (tmp_path / name).write_bytes(out)
    return str(tmp_path)


def test_versions_and_strange_files(spark, tmp_path):
    r = W.read_warc(spark, _archive(tmp_path, "a.warc", b"1.0", b"1.1", b"1.0")).collect()
    assert sorted((x.id, x.bytes, x.intact) for x in r) == [("0", 3, True), ("1", 3, True), ("2", 3, True)]
    _archive(tmp_path, "b.warc", b"1.0", head=b"junk")
    with pytest.raises(ValueError, match="b.warc"):
        W.read_warc(spark, str(tmp_path))


def test_threshold_and_empty(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("__payload_", F.lit(1))
    path = fresh_path(spark, "warc-test")
    W.write_warc(pages, path, least_bytes=2)
    assert read(spark, path) == brute(PAGES, 2)
    empty = fresh_path(spark, "warc-test")
    W.write_warc(pages.limit(0), empty)
    assert W.read_warc(spark, empty).count() == 0


def test_intervals_follow_chains():
    enter, leave, exits = W.chain_intervals([0, 5, 10, 20], [10, 20, 20, 40])
    on = lambda c, e: enter[c] <= enter[e] < leave[c]
    assert [on(c, 0) for c in range(4)] == [True, False, True, True] and exits == [40, 40, 40, 40]
    assert W.chain_intervals([0, 5], [3, 9])[2] == [None, 9]


def test_base32(spark):
    h = hashlib.sha1(b"abc").hexdigest()
    assert spark.range(1).select(W.base32(F.lit(h))).first()[0] == base64.b32encode(bytes.fromhex(h)).decode()
