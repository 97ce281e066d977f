"""WARC archives: writing with revisits and segments, and reading back with segment reassembly.

Writing: a page's payload goes into an HTTP response with chunked transfer framing. Of equal payloads of at least
``REVISIT_BYTES`` the one with the smallest id is a response and the others are revisits without payload. A block
beyond ``segment_bytes`` is cut into a first record and continuations. Spark's text sink writes the archives, with
the record end as its line separator and gzip; so any Hadoop file system holds them, and a lost task leaves nothing.

Reading: archives are unpacked as a stream, record by record. Segments are dealt by their origin's identifier, ordered
by segment number and passed through an HTTP and chunk decoder one at a time, so no task holds a group of segments;
their numbers must run from 1 without a gap and their lengths must add up to the last one's total, or ``complete`` is
false and payload columns are null. A record whose fields can't be read, and an archive from the place on where it is
cut short or isn't WARC, are a row of the type ``unreadable`` with ``complete`` false; the rest is read. ``binaryFile`` hands an archive to one task, so archives stay below 2 GB (the
writer's are as large as one input split).

A null payload is an empty one. Rows with one id keep a record each; where ids are equal or null among equal
payloads, every row with the smallest id is a response. Empty tables make empty archives and no rows. Ids have to
be integers. Columns other than the three named are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.llm.common import written

END = b"\r\n\r\n"
REVISIT_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def planned(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """``id``, ``url``, ``payload``, ``digest`` and ``refers_to``: null for responses."""
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long = F.octet_length("payload") >= REVISIT_BYTES
    first = rows.filter(long).groupBy(F.col("digest").alias("equal")).agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # Short payloads meet nothing and are spread by their ids; the written side lets a very common payload be split.
    equal = F.when(long, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("id", "url").cast("string")))
    joined = rows.withColumn("equal", equal).join(written(first, "first"), "equal", "left")
    return joined.select("id", "url", "payload", "digest", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def chunked(payload: bytes, size: int) -> bytes:
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the line ends that follow it."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block


def records(number: str, id, url: str | None, payload: bytes, digest: str, refers_to, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The records of one page."""
    clean = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    about = [("WARC-Date", DATE), ("WARC-Target-URI", clean), ("X-Page-Id", id), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", len(payload)), ("Content-Type", "application/http;msgtype=response")]
    name = f"<urn:loglens:record:{number}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to is not None:
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *about, ("WARC-Profile", PROFILE), ("X-Refers-To-Page-Id", refers_to)], http)
        return
    block = http + chunked(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        yield _record([("WARC-Type", "response"), ("WARC-Record-ID", name), *about], block)
        return
    starts = range(0, len(block), segment_bytes)
    for k, at in enumerate(starts, 1):
        last = [("WARC-Segment-Total-Length", len(block))] if k == len(starts) else []
        if k == 1:
            yield _record([("WARC-Type", "response"), ("WARC-Record-ID", name), *about, ("WARC-Segment-Number", 1)], block[:segment_bytes])
        else:
            yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:loglens:record:{number}:{k}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", k), *last], block[at : at + segment_bytes])


def write(plan: DataFrame, path: str, segment_bytes: int = 1 << 16, chunk_bytes: int = 1 << 13) -> None:
    """Archives of what ``planned`` returns."""

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            out, size = [], 0
            for row in batch.to_pylist():
                n += 1
                out += records(f"{part}-{n}", row["id"], row["url"], row["payload"], row["digest"], row["refers_to"], segment_bytes, chunk_bytes)
                size += len(row["payload"])
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    plan.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", END.decode()).option("compression", "gzip").text(path)


def unpacked(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of an archive piece by piece; gzip with any number of members, or plain."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[at : at + step] for at in range(0, len(data), step))
        return
    view, at = memoryview(data), 0
    while at < len(data):
        one = zlib.decompressobj(31)
        while not one.eof and at < len(data):
            piece = view[at : at + step // 8]
            yield one.decompress(piece)
            at += len(piece)
        at -= len(one.unused_data)


class _Reader:
    """Lines and runs of bytes from pieces."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, bytearray()

    def more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.held += piece
        return True

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise ValueError("an archive ends inside a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def until(self, mark: bytes) -> bytes | None:
        """What stands before ``mark``, which is dropped; None at the end of the archive."""
        at = 0
        while (found := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                if self.held.strip():
                    raise ValueError("an archive ends inside a header")
                return None
        out = bytes(self.held[:found])
        del self.held[: found + len(mark)]
        return out


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields by lower-case name, and block, of each record."""
    reader = _Reader(unpacked(data))
    while (head := reader.until(END)) is not None:
        version, *lines = head.strip(b"\r\n").decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record starts with {version[:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = fields.get("content-length", "")
        if not length.isascii() or not length.isdigit():
            raise ValueError("a record has no length")
        yield fields, reader.take(int(length))
        reader.take(len(END))


class Payload:
    """Decodes an HTTP response that comes in pieces: its header, then the body, chunked or plain."""

    def __init__(self, keep: bool = False):
        self.held, self.state, self.left = b"", "head", 0
        self.sha, self.size, self.kept = hashlib.sha256(), 0, [] if keep else None

    def out(self, data: bytes) -> None:
        self.sha.update(data)
        self.size += len(data)
        if self.kept is not None:
            self.kept.append(data)

    def feed(self, data: bytes) -> None:
        held = self.held + data
        while held:
            if self.state == "head":
                head, mark, rest = held.partition(END)
                if not mark:
                    break
                framed = any(x.split(b":")[0].strip().lower() == b"transfer-encoding" and b"chunked" in x.lower() for x in head.split(b"\r\n")[1:])
                self.state, held = "size" if framed else "plain", rest
            elif self.state == "plain":
                self.out(held)
                held = b""
            elif self.state == "size":
                line, mark, rest = held.partition(b"\r\n")
                if not mark:
                    break
                self.left = int(line.split(b";")[0], 16)
                self.state, held = "data" if self.left else "trailer", rest
            elif self.state == "data":
                part = held[: self.left]
                self.out(part)
                held, self.left = held[len(part) :], self.left - len(part)
                if not self.left:
                    self.state = "end"
            elif self.state == "end":
                if len(held) < 2:
                    break
                if held[:2] != b"\r\n":
                    raise ValueError("a chunk is longer than its size says")
                self.state, held = "size", held[2:]
            elif self.state == "trailer":
                line, mark, rest = held.partition(b"\r\n")
                if not mark:
                    break
                self.state, held = ("trailer" if line else "done"), rest
            else:
                break
        self.held = held

    def columns(self, stated: str | None, kind: str, segments: int) -> tuple:
        """From payload_bytes on, the columns of a response; nulls unless it is whole and has the digest that is stated."""
        digest = self.sha.hexdigest()
        good = self.state in ("plain", "done") and stated in (None, digest)
        return (self.size if good else None, digest if good else None, kind, None, segments, good, b"".join(self.kept) if good and self.kept is not None else None)


_FINAL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, segments long, complete boolean, payload binary"
_SCHEMA = f"origin string, segment long, total long, {_FINAL}, block binary"


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def parse(archives: DataFrame, keep_payload: bool = True) -> DataFrame:
    """A row for each record of archives that ``binaryFile`` has read: what is not segmented is decoded, segments keep their block."""

    def row(f: dict[str, str], block: bytes) -> tuple:
        kind, page, stated = f["warc-type"], _number(f.get("x-page-id")), f.get("warc-payload-digest", "").removeprefix("sha256:") or None
        if kind == "revisit":  # its header has the full payload's digest and length
            return (f["warc-record-id"], 0, None, page, _number(f.get("x-payload-length")), stated, kind, _number(f.get("x-refers-to-page-id")), 1, True, None, None)
        if "warc-segment-number" in f:
            return (f.get("warc-segment-origin-id", f["warc-record-id"]), int(f["warc-segment-number"]), _number(f.get("warc-segment-total-length")), page, None, stated, kind, None, 1, None, None, block)
        return (f["warc-record-id"], 0, None, page, *decoded([block], keep_payload, stated, kind, 1), None)

    def rows(data: bytes) -> Iterator[tuple[tuple, int]]:
        broken = (None, 0, None, None, None, None, "unreadable", None, 1, False, None, None)
        try:
            for f, block in parsed(data):
                if f.get("warc-type") in ("response", "revisit", "continuation"):
                    try:
                        yield row(f, block), len(block)
                    except (KeyError, ValueError):
                        yield broken, 0
        except (ValueError, zlib.error):
            yield broken, 0

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                out, size = [], 0
                for found, n in rows(data.as_py()):
                    out.append(found)
                    size += n
                    if size > 4 << 20 or len(out) >= 50_000:
                        yield _batch(out, _SCHEMA)
                        out, size = [], 0
                yield _batch(out, _SCHEMA)

    return archives.select("content").mapInArrow(run, _SCHEMA)


def decoded(blocks, keep: bool, stated: str | None, kind: str, segments: int) -> tuple:
    """From payload_bytes on, the columns of a response whose blocks are all there."""
    decoder = Payload(keep)
    try:
        for x in blocks:
            decoder.feed(x)
    except ValueError:
        decoder.state = "broken"
    return decoder.columns(stated, kind, segments)


_ARROW = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    columns = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _ARROW[kind]) for i, (_, kind) in enumerate(columns)], names=[name for name, _ in columns])


def reassemble(found: DataFrame, keep_payload: bool = True) -> DataFrame:
    """A row for each response or revisit: segments are put together, verified and decoded."""

    def finish(s: dict) -> tuple:
        if not s["sound"] or s["total"] != s["length"]:
            s["decoder"].state = "broken"
        return (s["page"], *s["decoder"].columns(s["stated"], "response", s["n"]))

    def run(batches):
        s: dict = {}
        for batch in batches:
            out, size = [], 0
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                origin, number, total, *final, block = (c[i].as_py() for c in columns)
                if s and origin != s["origin"]:
                    out.append(finish(s))
                    s = {}
                if number == 0:
                    out.append(tuple(final))
                    size += len(final[-1] or b"")
                else:
                    s = s or {"origin": origin, "page": None, "stated": None, "total": None, "length": 0, "n": 0, "sound": True, "decoder": Payload(keep_payload)}
                    s["n"] += 1
                    s["length"] += len(block)
                    s["total"] = s["total"] if total is None else total
                    s["sound"] &= number == s["n"]
                    if final[3] == "response":
                        s["page"], s["stated"] = final[0], final[2]
                    if s["sound"]:
                        try:
                            s["decoder"].feed(block)
                        except ValueError:
                            s["sound"] = False
                if size > 4 << 20:
                    yield _batch(out, _FINAL)
                    out, size = [], 0
            yield _batch(out, _FINAL)
        if s:
            yield _batch([finish(s)], _FINAL)

    return found.repartition("origin").sortWithinPartitions("origin", "segment").mapInArrow(run, _FINAL)


def read(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """Pages of the archives below ``path``."""
    return reassemble(parse(spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path), keep_payload), keep_payload)
