"""SpotSigs fingerprints.

After every anchor the next two content words form a chain; a text's fingerprint is the set of its chains' 64-bit
hashes, written as sorted hexadecimal. Anchors are the common words of four languages, which are no content; the start
of a text; and, so that texts in any language have some, one content word in ``SOME`` by its hash. The rule is the same
for texts of every length. Texts without content words have one signature of their bytes, and null and empty texts an
empty fingerprint. Likeness is the Jaccard similarity of the sets, cut short where set lengths or the rest that is left
to compare can't reach a wanted threshold (two empty sets are alike).

``near_duplicates`` compares in partitions of set lengths: a set of n meets sets of its own and the next longer
partition alone, on a shared signature of the few least ones that sets alike enough must share.

Rows with equal or null ids are documents of their own, nulls first and equal ids in the order of their packed
texts; they share a range of documents. Ids have to be integers (``compared`` raises a TypeError for others). Ranges
hold some ``RANGE_BYTES`` of text each. Very long texts need memory for themselves and their neighbour. Empty tables
give empty results; columns other than the id and the text are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglens.llm.common import trimmed, written
from loglens.llm.components import components
from loglens.llm.licenses import words
from loglens.llm.simhash import _least_of, by_cell, cell_numbers, forest, in_cells, whole_cells

#: Common words of English, German, French and Spanish.
ANCHORS = frozenset(
    "the a an and or of to in is was are be that it for on with this as at by from has have not "
    "der die das und ein eine ist war von zu den dem des mit für auf nicht sich auch im "
    "le la les un une et est de du des que qui dans pour sur avec pas par au "
    "el los las y es una en del con por para se no lo su".encode().split()
)
CHAIN, SOME = 2, 8
RANGE_BYTES, SPREAD = 32 << 20, 16


def signatures(text: bytes) -> list[int]:
    """The sorted set of a text's spot signatures."""
    f, found = xxhash.xxh64_intdigest, words(text)
    content = [w for w in found if w not in ANCHORS]
    out, k = set(), 0
    if content:
        padded = [*content, *[b""] * CHAIN]
        out.add(f(b":%b:%b" % (padded[0], padded[1])))
        for w in found:
            if w not in ANCHORS:
                k += 1
                if f(w) % SOME:
                    continue
            if padded[k]:
                out.add(f(b"%b:%b:%b" % (w, padded[k], padded[k + 1])))
    elif text:
        out.add(f(text, 1))
    return sorted(out)


def fingerprint(found: list[int]) -> str:
    return np.array(found, ">u8").tobytes().hex()


def jaccard(a: list[int], b: list[int], least: float = 0.0) -> float:
    """Similarity of two sorted sets; 0 as soon as it can't reach ``least``."""
    if not a or not b:
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    if len(a) < least * len(b):
        return 0.0
    if not least:
        same = len(set(a).intersection(b))
        return same / (len(a) + len(b) - same)
    need = least / (1 + least) * (len(a) + len(b))
    i = j = same = 0
    while i < len(a) and j < len(b):
        if same + min(len(a) - i, len(b) - j) < need - 1e-9:
            return 0.0
        if a[i] == b[j]:
            same, i, j = same + 1, i + 1, j + 1
        elif a[i] < b[j]:
            i += 1
        else:
            j += 1
    return same / (len(a) + len(b) - same)


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Ranges of documents in order: bucket, ``extra``, id and packed text. A bucket's last document finds the one after it as an extra row.

    Buckets start at ids that occur, so the first document of each bucket is known and goes to the one before too.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"documents are compared in the order of integer ids; {id_col} is {docs.schema[id_col].dataType.simpleString()}")
    ids = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.octet_length(F.col(f"`{text_col}`")).alias("n"))
    low, nulls, size, many = ids.agg(F.min("id"), F.count_if(F.col("id").isNull()), F.sum("n"), F.count("*")).first()
    wanted = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((size or 0) / RANGE_BYTES))
    # Of some SPREAD ids for each range, picked by their hash, every SPREAD-th is a bound: each is an id of a document, however large.
    part = min(1.0, SPREAD * wanted / max(1, many))
    picked = ids.filter((F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int(part * (1 << 40))) & F.col("id").isNotNull()).select("id").distinct()
    found = sorted(r[0] for r in picked.collect() if r[0] != low)
    bounds = np.array(found[max(1, len(found) // wanted) - 1 :: max(1, len(found) // wanted)][: wanted - 1], np.int64)

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for a in range(0, batch.num_rows, 500):
                part = batch.column(0).slice(a, 500)
                null = np.array(part.is_null())
                id = part.fill_null(0).to_numpy(zero_copy_only=False)
                bucket = np.where(null, 0, np.searchsorted(bounds, id, "right"))
                z = pa.array([press.compress(x.as_py() or b"") for x in texts.slice(a, 500)], pa.binary())
                start = ~null & (bucket > 0) & (id == bounds[bucket - 1]) if len(bounds) else np.zeros(len(id), bool)
                first = null if nulls else ~null & (id == low)
                for which, to, extra in ((slice(None), bucket, 0), (start, bucket - 1, 1), (first, np.full(len(id), len(bounds)), 2)):
                    rows = np.arange(len(id))[which]
                    yield pa.RecordBatch.from_arrays([pa.array(to[rows].astype(np.int64)), pa.array(np.full(len(rows), extra, np.int32)), part.take(pa.array(rows)), z.take(pa.array(rows))], names=["bucket", "extra", "id", "z"])

    dealt = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`")).mapInArrow(trimmed(run), "bucket long, extra int, id long, z binary")
    return dealt.repartition(len(bounds) + 1, "bucket").sortWithinPartitions("bucket", "extra", "id", "z")


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by as many of the following text's first, or all of them."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    dealt = with_next(docs, id_col, text_col)
    schema = f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0].strip("`") for x in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def row(held, following):
        id, text, found = held
        new = edited(text, following[1]).encode()
        changed = signatures(new)
        return id, len(text), hashlib.sha256(new).hexdigest(), fingerprint(found), fingerprint(changed), jaccard(found, changed), jaccard(found, following[2])

    def run(batches):
        opened = zstandard.ZstdDecompressor()
        held, at, out, size = None, None, [], 0

        def ended():
            if held is not None:
                raise RuntimeError(f"document {held[0]} has no next one")

        for batch in batches:
            for bucket, extra, id, z in zip(*batch.columns, strict=True):
                bucket, extra = bucket.as_py(), extra.as_py()
                if bucket != at:
                    ended()
                    held, at = None, bucket
                if extra and held is None:
                    continue  # the first of the following documents has served already
                data = opened.decompress(z.as_py())
                now = (id.as_py(), data.decode(), signatures(data))
                if held is not None:
                    out.append(row(held, now))
                    size += len(data)
                held = None if extra else now
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                out, size = [], 0
        ended()

    return dealt.mapInArrow(trimmed(run), schema)


def partitions(longest: int, least: float) -> list[int]:
    """Starts of set-length partitions so wide that sets ``least`` alike are in one or in neighbouring ones."""
    out = [1]
    while out[-1] <= longest:
        out.append(max(out[-1] + 1, int(out[-1] / least) + 1))
    return out


def near_duplicates(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ``fp`` (class of equal sets) and ``component_id``; classes are linked where they are ``least`` alike."""
    kind = docs.schema[id_col].dataType.simpleString()

    def mark(batches):
        for batch in batches:
            found = [signatures(x.as_py() or b"") for x in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.array(s, "<u8").tobytes() for s in found], pa.binary())], names=["doc_id", "s"])

    prints = written(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(trimmed(mark), f"doc_id {kind}, s binary").withColumn("fp", F.xxhash64("s")), "prints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("s").alias("s")), "classes")

    def deal(batches):
        for batch in batches:
            at, keys = [], []
            for i, s in enumerate(batch.column(1)):
                own = np.frombuffer(s.as_py(), "<u8")
                starts = partitions(len(own), least)
                part = int(np.searchsorted(starts, len(own), "right")) - 1
                rarest = own[: len(own) - int(np.ceil(least * len(own) - 1e-9)) + 1]
                mine = [xxhash.xxh64_intdigest(b"%d:%d" % (p, x)) for x in rarest.tolist() for p in (part, part + 1)]
                at += [i] * len(mine)
                keys += mine
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), batch.column(0).take(pa.array(at, pa.int64()))], names=["key", "id"])

    rows = classes.select("fp", "s").mapInArrow(trimmed(deal), "key long, id long")
    full = in_cells(rows).join(classes.select(F.col("fp").alias("id"), "s"), "id").select("key", "lo", "hi", "id", "s")

    def compare(batches):
        for table in whole_cells(batches, 5):
            cell, fp = cell_numbers(table), table.column("id").to_numpy()
            sets = [np.frombuffer(x.as_py(), "<u8").tolist() for x in table.column("s")]
            order = sorted(range(len(fp)), key=lambda i: (cell[i], len(sets[i])))
            left, right = [], []
            for x in range(len(order)):
                for y in range(x + 1, len(order)):
                    i, j = order[x], order[y]
                    if cell[i] != cell[j] or len(sets[i]) < least * len(sets[j]):
                        break
                    if jaccard(sets[i], sets[j], least) >= least:
                        left.append(i)
                        right.append(j)
            node, root = forest(np.array(left, np.int64), np.array(right, np.int64), len(fp))
            yield pa.RecordBatch.from_arrays([pa.array(fp[node]), pa.array(fp[root])], names=["a", "b"])

    found = by_cell(full).mapInArrow(trimmed(compare), "a long, b long").distinct()
    return _least_of(prints.select("doc_id", "fp"), classes.select("fp", "least"), components(found))

