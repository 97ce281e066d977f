import gzip
import hashlib

from pyspark.sql import functions as F

from loglens.llm import queries, warc
from loglens.llm.common import new_path, table


def brute(rows):
    data = [(i, (h or "").encode()) for i, h in rows]
    first = {}
    for i, d in data:
        if len(d) >= 100 and i is not None:
            first[d] = min(i, first.get(d, i))
    counts = {d: sum(x == d for _, x in data) for _, d in data}
    out = []
    for i, d in data:
        to = first.get(d) if counts[d] > 1 and first.get(d) != i else None
        out.append((i, len(d), hashlib.sha256(d).hexdigest(), "response" if to is None else "revisit", to))
    return out


def key(r):
    return tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)


def rows_of(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=key)


def test_edges(spark):
    long = "".join(f"{i}é\r\n\r\nWARC/1.1\r\n" for i in range(30_000))
    same = "x" * 100
    rows = [(1, None), (2, ""), (9, same), (3, same), (3, same), (None, same), (4, "y" * 99), (5, "y" * 99), (6, long), (7, long), (8, "0\r\n\r\n"), (None, None)]
    pages = spark.createDataFrame([(i, None if i == 1 else f"http://h/{i}\r\nX: y", h, "z") for i, h in rows], "page_id long, url string, html string, digest string")
    path = new_path(spark, "warc")
    warc.write(warc.planned(pages), path, segment_bytes=1 << 12, chunk_bytes=1000)
    got = warc.read(spark, path)
    assert rows_of(got) == sorted(brute(rows), key=key)
    assert got.filter("page_id = 6").first().payload.decode() == long and got.filter("page_id = 6").first().segments > 100
    empty = new_path(spark, "warc")
    warc.write(warc.planned(pages.limit(0)), empty)
    assert spark.read.format("binaryFile").load(empty).count() == 0 or warc.read(spark, empty).count() == 0


def archive(parts):
    return gzip.compress(b"".join(p + warc.END for p in parts[:2])) + gzip.compress(b"".join(p + warc.END for p in parts[2:]))


def test_segments_that_are_lost_or_doubled(spark):
    parts = list(warc.records("1", 5, "u", b"payload " * 500, hashlib.sha256(b"payload " * 500).hexdigest(), None, 700, 64))
    frame = lambda p: spark.createDataFrame([(bytearray(archive(p)),)], "content binary")
    read = lambda p: warc.reassemble(warc.parse(frame(p))).collect()
    whole = read([parts[0], *reversed(parts[1:])])
    assert len(whole) == 1 and whole[0].complete and whole[0].payload == b"payload " * 500
    for broken in (parts[:-1], parts[1:], [*parts[:3], *parts[4:]], [*parts, parts[2]], [parts[0].replace(b"payload", b"paxload"), *parts[1:]]):
        found = read(broken)
        assert len(found) == 1 and not found[0].complete and found[0].payload_digest is None


def test_archives_that_cannot_be_read(spark):
    """What is broken is a row that says so; what stands before it, and other archives, are read."""
    part = list(warc.records("1", 5, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, 1 << 16, 64))
    other = list(warc.records("2", 6, "u", b"other", hashlib.sha256(b"other").hexdigest(), None, 1 << 16, 64))
    whole = archive([*part, *other])
    odd = {
        "cut short": (gzip.compress(b"".join(p + warc.END for p in part) + other[0][:60]), [5, None]),
        "gzip cut short": (whole[:-30], [5, None]),
        "no gzip after the magic": (b"\x1f\x8bxxxxxxxxxxxxxxxx", [None]),
        "no archive": (b"hello\r\n\r\nworld", [None]),
        "no length": (archive([part[0].replace(b"Content-Length", b"Content-Longness"), *other]), [None]),
        "no type": (archive([part[0].replace(b"WARC-Type", b"WARC-Kind"), *other]), [6]),
        "no name": (archive([part[0].replace(b"WARC-Record-ID", b"WARC-Record-IX"), *other]), [6, None]),
        "an id that is no number": (archive([part[0].replace(b"X-Page-Id: 5", b"X-Page-Id: five"), *other]), [6, None]),
        "bytes that are no text": (archive([part[0].replace(b"URI: u", b"URI: \xff\xfe"), *other]), [5, 6]),
        "nothing": (b"", []),
    }
    for name, (data, pages) in odd.items():
        got = warc.reassemble(warc.parse(spark.createDataFrame([(bytearray(data),)], "content binary"))).collect()
        assert sorted((r.page_id for r in got), key=str) == sorted(pages, key=str), name
        assert all(r.complete == (r.record_type != "unreadable") for r in got), name


def test_framing():
    body = b"5;ext=1\r\nhello\r\n6\r\n world\r\n0\r\nTrailer: x\r\n\r\n"
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: Chunked\r\n\r\n"
    for step in range(1, 20):
        p = warc.Payload(keep=True)
        data = head + body
        for at in range(0, len(data), step):
            p.feed(data[at : at + step])
        assert b"".join(p.kept) == b"hello world" and p.state == "done"
    p = warc.Payload(keep=True)
    p.feed(b"HTTP/1.1 200 OK\r\n\r\nplain")
    assert b"".join(p.kept) == b"plain" and p.state == "plain"


def test_query(spark, sf):
    got = queries.op1_warc(spark, sf)
    assert rows_of(got) == sorted(brute([(r.page_id, r.html) for r in table(spark, sf, "pages").collect()]), key=key)
    assert got.filter(~F.col("complete")).count() == 0
