"""SimHash near-duplicates with pivot distance tables.

A fingerprint has a bit set where over half of the hashes of a text's word shingles have it. Texts with one
fingerprint are one class, and only classes are compared. Fingerprints with at most ``radius`` differing bits agree
in all but that many of a few blocks, so classes meet in buckets keyed by every choice of the blocks that agree.
Within a bucket a table holds each fingerprint's Hamming distances to reference fingerprints (pivots). By the
triangle inequality a pair further apart in any coordinate than ``radius`` can't be linked: rows are ordered by the
first coordinate and compared only within that reach, then discarded by their greatest coordinate difference, and
survivors are verified bit by bit. The table is made once, sixteen distances in two longs beside each class, and goes
with it into its buckets. A bucket gives a spanning forest of its links, never all pairs. A bucket beyond
``BUCKET`` classes is dealt into chunks, and every two chunks meet in a task of their own, so that none is cut short.

``near_duplicates`` serves texts that differ by some edits and is exact on the sets of 64-bit hashes of their
shingles. Sets of Jaccard similarity s or more share a hash among the first n - ceil(s n) + 1 of each, in any one
order; that order has hashes that many texts hold last (an estimate that only costs or saves time). Classes meet under
such hashes; of hashes that the same classes hold one is enough. A class's fingerprint there is a bitmap of the
parities of its hashes: the distance of two is never above the sets' symmetric difference, and so neither is that of
their sizes or of their distances to a pivot. The bitmap has about a bit for each hash (a narrow one would be full and
tell nothing of large sets); a wider one is folded to the width of a narrower one, by exclusive or. Pairs beyond what
alike sets may differ by go in this order: by size, by greatest coordinate difference, by the bitmaps. The components of what is left are dealt into cells of up to ``CHUNK``
classes and some ``CHUNK_WORDS`` words a side, where the sets themselves decide, made anew from the texts of those
classes alone.

Nulls are empty texts; a text without words has fingerprint zero and is linked like any other. Repeated rows and
rows with one doc_id keep a row each; a null doc_id is never the least of a component that has another. Empty tables
give empty results, and columns other than the id and the text are not looked at, whatever their names. Hot keys (a
bucket, a class of copies, a component) meet their counterpart in joins of two shuffled tables, which adaptive
execution splits.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import free, remove, trimmed, written
from loglens.llm.components import components

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Classes of a bucket that one task compares; more are dealt into chunks.
BUCKET = 2_000
PIVOTS = 16
BLOCK = 1 << 18  # hashes whose bits are counted at once, by 64-bit words
#: Least and greatest bits of a bitmap of parities, powers of two; the greatest only saves time.
PARITIES, MOST_PARITIES = 1024, 1 << 14
#: Hashes counted at once to tell common ones, how often they must occur there, and how many are told at most.
COUNTED, OFTEN, COMMON = 1 << 20, 4, 100_000
#: Classes of a component of candidates, and words of their texts, whose sets one task holds; more are dealt into chunks.
CHUNK, CHUNK_WORDS = 500, 3 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64 over unsigned 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pivots(n: int, words: int) -> np.ndarray:
    return mix(np.arange(1, n * words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(n, words)


def split(text: bytes) -> list[bytes]:
    """Words: A-Z lower-cased, parted by ASCII white space."""
    return text.translate(LOWER).split()


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """Runs of ``size`` words, repeats included; all words where there are fewer; none of none."""
    joined = b" ".join(words)
    if len(words) <= size:
        return [joined] if words else []
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    return [joined[s : e - 1] for s, e in zip(starts, starts[size:], strict=False)]


def majority(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprint of each run of hashes (rows of one or more 64-bit words) that ends at ``ends``; zero for empty runs."""
    words = hashes.shape[1]
    block = BLOCK // words
    out = np.zeros((len(ends), words), np.uint64)
    starts = np.concatenate(([0], ends[:-1]))
    for i in np.flatnonzero(ends - starts > block):  # in pieces, so that a long text needs no more memory
        counts = sum(np.unpackbits(hashes[a : min(a + block, ends[i])].view(np.uint8).reshape(-1, words * 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for a in range(starts[i], ends[i], block))
        out[i] = np.packbits(counts * 2 > ends[i] - starts[i], bitorder="little").view(np.uint64)
    some = np.flatnonzero((ends > starts) & (ends - starts <= block))
    at = 0
    while at < len(some):
        to = max(at + 1, int(np.searchsorted(np.cumsum(ends[some[at:]] - starts[some[at:]]), block, "right")) + at)
        part = some[at:to]
        sizes = ends[part] - starts[part]
        rows = np.concatenate([hashes[starts[i] : ends[i]] for i in part])
        bits = np.unpackbits(rows.view(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0, dtype=np.int32)
        out[part] = np.packbits(counts * 2 > sizes[:, None], axis=1, bitorder="little").view(np.uint64)
        at = to
    return out


def _groups(column: pa.Array, most: int = 1 << 18):
    """Runs of a batch's texts as bytes, with the first row of each."""
    start, size, out = 0, 0, []
    for i, x in enumerate(column.cast(pa.binary())):
        out.append(x.as_py() or b"")
        size += len(out[-1])
        if size >= most:
            yield start, out
            start, size, out = i + 1, 0, []
    if out:
        yield start, out


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fp``: the 64 bits as a long."""

    def run(batches):
        f = xxhash.xxh64_intdigest
        for batch in batches:
            for start, texts in _groups(batch.column(1)):
                hashes, ends = [], []
                for t in texts:
                    hashes += [f(s, seed) for s in shingles(split(t), shingle)]
                    ends.append(len(hashes))
                found = majority(np.array(hashes, np.uint64).reshape(-1, 1), np.array(ends))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array(found[:, 0].view(np.int64))], names=["doc_id", "fp"])

    return docs.select(id_col, text_col).mapInArrow(trimmed(run), f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp long")


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the least node that the given edges connect it with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            node = np.flatnonzero(label != np.arange(n))
            return node, label[node]
        label = new


def linked(cell: np.ndarray, first: np.ndarray, reach: float, alike) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one cell, rows being in the order of the cell and the first coordinate.

    alike(i, j): which of the pairs survive the pivots' other coordinates and verification.
    """
    left, right, at = [], [], np.arange(len(cell))
    for step in range(1, len(cell)):
        at = at[at + step < len(cell)]
        at = at[(cell[at + step] == cell[at]) & (first[at + step] - first[at] <= reach)]
        if not len(at):
            break
        for k in range(0, len(at), 50_000):
            part = at[k : k + 50_000]
            good = part[alike(part, part + step)]
            if len(good):
                left.append(good)
                right.append(good + step)
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def dealt(rows: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """``rows`` of the keys in ``sizes`` (``key``, ``n``), with the cell (``lo``, ``hi``) of up to twice ``most`` rows in which they are compared."""
    chunks = F.ceil(F.col("n") / most).cast("long")
    mine = F.pmod(F.xxhash64("id"), chunks)
    other = F.explode(F.when(chunks == 1, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), chunks - 1)))
    both = rows.join(sizes, "key").select(*rows.columns, mine.alias("mine"), other.alias("other"))
    return both.select("key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), *[c for c in rows.columns if c != "key"])


def in_cells(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Rows (``key``, ``id`` and more) of keys that two or more share, dealt into cells. The sizes are a table of their own, so that the join with them can be split."""
    sizes = written(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    return dealt(rows, sizes, most or BUCKET)


def by_cell(cells: DataFrame, key: str = "key") -> DataFrame:
    return cells.repartition(key, "lo", "hi").sortWithinPartitions(key, "lo", "hi")


def whole_cells(batches, columns: int):
    """Arrow batches ordered by cell (the first three columns) as lists of numpy columns that hold whole cells."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if rest is None else [rest, batch])
        cell = np.stack([table.column(i).to_numpy() for i in range(3)])
        change = np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(0)) + 1
        if not len(change):
            rest = table.combine_chunks().to_batches()[0] if len(table) else None
            continue
        yield table.slice(0, change[-1])
        rest = table.slice(change[-1]).combine_chunks().to_batches()[0]
    if rest is not None:
        yield pa.Table.from_batches([rest])


def cell_numbers(table: pa.Table) -> np.ndarray:
    cell = np.stack([table.column(i).to_numpy() for i in range(3)])
    return np.concatenate(([0], np.cumsum((cell[:, 1:] != cell[:, :-1]).any(0))))



def coordinates() -> list:
    """A fingerprint's distances to the pivots, a byte each, as two longs: ``c0`` and ``c1``."""
    distance = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("long") for p in pivots(PIVOTS, 1)[:, 0].view(np.int64).tolist()]
    packed = lambda some: reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(d, 8 * i) for i, d in enumerate(some)])
    return [packed(distance[:8]).alias("c0"), packed(distance[8:]).alias("c1")]


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Edges ``a``, ``b`` that span every component of distinct fingerprints ``fp`` linked at ``radius`` or fewer bits."""
    blocks = radius + 2
    width = 64 // blocks
    part = [F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit((1 << (width if i < blocks - 1 else 64 - i * width)) - 1)) for i in range(blocks)]
    keys = F.array(*[F.xxhash64(F.lit(10 * i + j), part[i], part[j]) for i, j in combinations(range(blocks), 2)])
    table = prints.select("fp", *coordinates())
    rows = table.select(F.explode(keys).alias("key"), F.col("fp").alias("id"), "c0", "c1")

    def run(batches):
        for table in whole_cells(batches, 6):
            cell, fp = cell_numbers(table), table.column("id").to_numpy()
            at = np.stack([table.column("c0").to_numpy(), table.column("c1").to_numpy()], 1).view(np.uint8).astype(np.int16)
            order = np.lexsort((at[:, 0], cell))
            cell, fp, at = cell[order], fp[order], at[order]

            def alike(i, j, fp=fp, at=at):
                good = (np.abs(at[i] - at[j]).max(1) <= radius).nonzero()[0]
                out = np.zeros(len(i), bool)
                out[good] = np.bitwise_count((fp[i[good]] ^ fp[j[good]]).view(np.uint64)) <= radius
                return out

            node, root = forest(*linked(cell, at[:, 0], radius, alike), len(fp))
            yield pa.RecordBatch.from_arrays([pa.array(fp[node]), pa.array(fp[root])], names=["a", "b"])

    return by_cell(in_cells(rows)).mapInArrow(trimmed(run), "a long, b long").distinct()


def clusters(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``fp`` and ``component_id``, the least doc_id that links reach."""
    prints = written(fingerprints(docs, shingle, id_col=id_col, text_col=text_col), "prints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    star = components(links(classes.select("fp"), radius))
    return _least_of(prints, classes, star)


def _least_of(prints: DataFrame, classes: DataFrame, star: DataFrame) -> DataFrame:
    """Per row the least doc_id of its class's component; star: class, root for classes that aren't roots."""
    rooted = star.select(F.col("u").alias("fp"), F.col("v").alias("root")).unionByName(star.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct())
    linked = written(rooted.join(classes.select("fp", "least"), "fp"), "linked")
    least = written(linked.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    known = written(linked.join(least, "root").select("fp", "component_id"), "known")
    named = written(classes.select("fp", "least").join(known, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def _sets(texts: list[bytes], shingle: int) -> tuple[list[int], list[np.ndarray]]:
    """A hash of each text's words in order, which tells classes of equal words, and its sorted distinct shingle hashes."""
    f, whole, sets = xxhash.xxh64_intdigest, [], []
    for t in texts:
        words = split(t)
        whole.append(f(b" ".join(words)))
        sets.append(np.unique(np.fromiter(map(f, shingles(words, shingle)), np.uint64)))
    return whole, sets


def widths(size: np.ndarray) -> np.ndarray:
    """Bits of the bitmaps of sets: the power of two from the size on, within the bounds."""
    return 1 << np.ceil(np.log2(np.clip(size, PARITIES, MOST_PARITIES))).astype(np.int64)


def folded(bits: list[bytes], width: int) -> np.ndarray:
    """Bitmaps of ``width`` bits or more, folded to that width by exclusive or, as rows of 64-bit words."""
    if not bits:
        return np.zeros((0, width // 64), np.uint64)
    times = np.array([len(x) for x in bits]) * 8 // width
    return np.bitwise_xor.reduceat(np.frombuffer(b"".join(bits), np.uint64).reshape(-1, width // 64), np.cumsum(times) - times, axis=0)


def common_hashes(docs: DataFrame, shingle: int) -> np.ndarray:
    """Sorted hashes that many sets hold, as far as counts of runs of texts tell; they only go last in the order of prefixes."""

    def told(held: list[np.ndarray]) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(held), return_counts=True)
        often = n >= OFTEN
        return pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(n[often], pa.int64())], names=["key", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for _, texts in _groups(batch.column(0)):
                held += _sets(texts, shingle)[1]
                size += sum(map(len, held[-len(texts) :]))
                if size >= COUNTED:
                    yield told(held)
                    held, size = [], 0
        if held:
            yield told(held)

    counts = docs.select("text").mapInArrow(trimmed(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.col("n").desc(), "key").limit(COMMON).select("key").toArrow().column(0)
    return np.sort(top.to_numpy().view(np.uint64))


def sketches(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``doc_id``, ``fp`` (see _sets), ``size``, ``parities``, ``pivots`` (the bitmap's distances to reference bitmaps) and ``prefix``: the first hashes, of which alike sets share one.

    A class that a task meets again has ``fp`` alone.
    """
    held = docs.sparkSession.sparkContext.broadcast(common_hashes(docs, shingle))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        common, seen = held.value, set()
        references = pivots(PIVOTS, PARITIES // 64)
        for batch in batches:
            for start, texts in _groups(batch.column(0)):
                whole, sets = _sets(texts, shingle)
                fresh = []
                for i, x in enumerate(whole):
                    if x not in seen:
                        seen.add(x)
                        fresh.append(i)
                size = np.array([len(sets[i]) for i in fresh], np.int64)
                hashes = np.concatenate([np.zeros(0, np.uint64), *(sets[i] for i in fresh)])
                of = np.repeat(np.arange(len(size)), size)
                wide = widths(size)
                begin = np.cumsum(wide) - wide
                odd = np.bincount(begin[of] + (hashes & (wide[of] - 1).astype(np.uint64)).astype(np.int64), minlength=int(wide.sum())) & 1
                bits = np.packbits(odd.astype(np.uint8))
                bits = [bits[a // 8 : (a + w) // 8].tobytes() for a, w in zip(begin.tolist(), wide.tolist(), strict=True)]
                far = np.bitwise_count(folded(bits, PARITIES)[:, None] ^ references).sum(2).astype("<i2")
                last = np.zeros(len(hashes), bool)
                if len(common):
                    last = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
                order = np.argsort(of * 2 + last, kind="stable")
                place = np.arange(len(hashes)) - np.repeat(np.cumsum(size) - size, size)
                first = size - np.ceil(similarity * size - 1e-6).astype(np.int64) + 1
                taken = hashes[order][place < first[of]].view(np.int64)
                n = np.minimum(first, size)
                ends = np.zeros(len(texts) + 1, np.int32)
                ends[np.array(fresh, np.int64) + 1] = n
                at = np.full(len(texts), -1)
                at[fresh] = np.arange(len(fresh))
                rows = pa.array(at, mask=at < 0)
                take = lambda values, kind: pa.array(values, kind).take(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(start, len(texts)), pa.array(np.array(whole, np.uint64).view(np.int64)), take(size, pa.int32()), take(bits, pa.binary()), take([x.tobytes() for x in far], pa.binary()), pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(taken))],
                    names=["doc_id", "fp", "size", "parities", "pivots", "prefix"],
                )

    return docs.select("text", "doc_id").mapInArrow(trimmed(run), f"doc_id {kind}, fp long, size int, parities binary, pivots binary, prefix array<long>")


def packed_classes(docs: DataFrame) -> DataFrame:
    """``fp``, the compressed words ``z`` and their number ``words`` of every class that a task meets."""

    def run(batches):
        press, seen = zstandard.ZstdCompressor(level=1), set()
        for batch in batches:
            for _, texts in _groups(batch.column(0)):
                out, n = {}, []
                for t in texts:
                    words = split(t)
                    joined = b" ".join(words)
                    if (fp := xxhash.xxh64_intdigest(joined)) not in seen:
                        seen.add(fp)
                        out[fp] = press.compress(joined)
                        n.append(len(words))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(list(out), np.uint64).view(np.int64)), pa.array(list(out.values()), pa.binary()), pa.array(n, pa.int64())], names=["fp", "z", "words"])

    return docs.select("text").mapInArrow(trimmed(run), "fp long, z binary, words long")


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``fp`` and ``component_id``; classes are linked where their shingles are ``similarity`` alike."""
    return _near(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), shingle, similarity)


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, all columns as they are, that stay: of every component the one with the least id (nulls last), then text hash."""
    id, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    who = F.struct(id.isNull().alias("null"), id.alias("id"), F.xxhash64(text).alias("raw"))
    found = _near(docs.select(who.alias("doc_id"), text.alias("text")), shingle, similarity)
    key, raw, mine = free(docs, "id", "raw", "hash")
    kept = found.filter("doc_id = component_id").select(F.col("doc_id.id").alias(key), F.col("doc_id.raw").alias(raw))
    again = not kept.groupBy(key, raw).count().filter("count > 1").isEmpty()
    out = docs.withColumn(mine, F.xxhash64(text)).join(kept.distinct() if again else kept, id.eqNullSafe(F.col(key)) & (F.col(mine) == F.col(raw)), "left_semi")
    return (out.dropDuplicates([id_col, mine]) if again else out).drop(mine)


def alike_sets(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each set to one of its component, sets being linked where their Jaccard similarity is ``similarity`` or more."""
    size, n = np.array([len(s) for s in sets]), len(sets)
    hashes = np.concatenate(sets)
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    fresh = np.concatenate(([True], hashes[1:] != hashes[:-1]))
    start = np.flatnonzero(fresh)
    length = np.diff(np.append(start, len(hashes)))
    run = np.empty(len(hashes), np.int32)
    run[order] = np.cumsum(fresh, dtype=np.int32) - 1
    holders, ends, label = np.repeat(np.arange(n, dtype=np.int32), size)[order], np.cumsum(size), np.arange(n)
    del hashes, order, fresh
    mark = np.zeros(len(start), bool)
    for i in range(n - 1):
        others = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        others = others[np.minimum(size[others], size[i]) >= similarity * np.maximum(np.maximum(size[others], size[i]), 1) - 1e-6]
        if not len(others):
            continue
        mine = run[ends[i] - size[i] : ends[i]]
        many = length[mine]
        if size[others].sum() <= many.sum():  # few are left: their own hashes are looked at
            mark[mine] = True
            last = np.cumsum(size[others])
            places = np.arange(last[-1]) + np.repeat(ends[others] - last, size[others])
            both = np.add.reduceat(mark[run[places]], last - size[others], dtype=np.int64)
            mark[mine] = False
        else:
            places = np.arange(many.sum()) + np.repeat(start[mine] - (np.cumsum(many) - many), many)
            both = np.bincount(holders[places], minlength=n)[others]
        good = others[both / (size[i] + size[others] - both) >= similarity]
        if len(good):
            label[np.isin(label, label[good])] = label[i]
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def verified(star: DataFrame, classes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Edges ``a``, ``b`` that span every component of classes (``fp``, ``z``, ``words``) whose sets are alike.

    star: the components of candidates, so that alike sets are in one of them.
    """
    members = star.select(F.col("v").alias("key"), F.col("u").alias("id")).union(star.select("v", F.col("v").alias("id")).distinct())

    def run(batches):
        opened = zstandard.ZstdDecompressor()
        for table in whole_cells(batches, 5):
            ends = np.append(np.flatnonzero(np.diff(cell_numbers(table))) + 1, len(table))
            fp, found, a = table.column("id").to_numpy(), [], 0
            for b in ends.tolist():
                node, root = alike_sets(_sets([opened.decompress(x.as_py()) for x in table.column("z").slice(a, b - a)], shingle)[1], similarity)
                found.append(fp[a + np.stack((node, root))])
                a = b
            both = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    counts = members.join(classes.select(F.col("fp").alias("id"), "words"), "id").groupBy("key").agg(F.count("*").alias("n"), F.sum("words").alias("words"))
    sizes = written(counts.select("key", F.greatest("n", F.ceil(F.col("words") * (CHUNK / CHUNK_WORDS))).alias("n")), "sizes")
    cells = dealt(members, sizes, CHUNK).join(classes.select(F.col("fp").alias("id"), "z"), "id").select("key", "lo", "hi", "id", "z")
    return by_cell(cells).mapInArrow(trimmed(run), "a long, b long").distinct()


def candidates(cell: np.ndarray, size: np.ndarray, similarity: float, alike) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the components of a cell's pairs whose sizes allow ``similarity``, rows being in the order of cell and size.

    alike(i, j): which of the pairs are left by verification. Pairs that earlier ones connect aren't looked at.
    """
    n, at = len(cell), np.arange(len(cell))
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    label, node, root, fresh = np.arange(n), [], [], False
    for step in range(1, n):
        at = at[at + step < n]
        at = at[(cell[at + step] == cell[at]) & (size[at] >= similarity * size[at + step] - 1e-6)]
        if not len(at):
            break
        pairs = at[label[at] != label[at + step]]
        for k in range(0, len(pairs), 50_000):
            part = pairs[k : k + 50_000]
            good = part[alike(part, part + step)]
            node.append(good)
            root.append(good + step)
            fresh |= len(good) > 0
        if fresh and step & (step - 1) == 0:
            a, b = forest(np.concatenate(node), np.concatenate(root), n)
            label = np.arange(n)
            label[a] = b
            node, root, fresh = [a], [b], False
            parted = np.minimum.reduceat(label, first) != np.maximum.reduceat(label, first)
            at = at[parted[cell[at]]]
    none = np.zeros(0, np.int64)
    return forest(np.concatenate([none, *node]), np.concatenate([none, *root]), n)


def shared_keys(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (``key``, ``id``) of keys that occur twice, and ``key``, ``n`` of the least of all keys that one set of ids shares: the pairs of the others are its pairs."""
    met = written(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "met")
    shared = written(rows.join(met, "key").repartition("id", "key"), "shared")  # else a frequent key lies in few files, and reading them again can't split it
    h, part = [F.xxhash64("id"), F.xxhash64("id", F.lit(1))], F.lit((1 << 30) - 1)
    sums = [F.sum(x.bitwiseAND(part)) for x in (h[0], F.shiftrightunsigned(h[0], 32), h[1], F.shiftrightunsigned(h[1], 32))]
    groups = shared.groupBy("key").agg(F.count("*").alias("n"), *[x.alias(f"s{i}") for i, x in enumerate(sums)])
    keys = written(groups.groupBy("n", "s0", "s1", "s2", "s3").agg(F.min("key").alias("key")).select("key", "n"), "keys")
    remove(met)
    return shared, keys


def _near(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Per row: doc_id, fp, component_id, as a written table; docs: ``doc_id`` and ``text``."""
    prints = written(sketches(docs, shingle, similarity), "prints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("size").alias("size"), F.min("parities").alias("parities"), F.min("pivots").alias("pivots")), "classes")
    shared, keys = shared_keys(prints.select(F.explode("prefix").alias("key"), F.col("fp").alias("id")))
    cells = dealt(shared, keys, BUCKET)
    full = cells.join(classes.select(F.col("fp").alias("id"), "size", "parities", "pivots"), "id").select("key", "lo", "hi", "id", "size", "parities", "pivots")
    apart = (1 - similarity) / (1 + similarity)  # most of the symmetric difference of alike sets, as a share of both sizes

    def run(batches):
        for table in whole_cells(batches, 7):
            cell, fp, size = cell_numbers(table), table.column("id").to_numpy(), table.column("size").to_numpy()
            order = np.lexsort((fp, size, cell))
            order = order[np.append(True, (cell[order][1:] != cell[order][:-1]) | (fp[order][1:] != fp[order][:-1]))]  # a class comes from each task that met it
            far = np.frombuffer(b"".join(table.column("pivots").to_pylist()), "<i2").reshape(len(fp), -1)[order]
            bits = table.column("parities").take(pa.array(order)).to_pylist()
            cell, fp, size = (x[order] for x in (cell, fp, size))
            wide = widths(size)
            narrow, maps, w = folded(bits, PARITIES), {}, 2 * PARITIES
            while w <= wide.max():  # row of each bitmap that is so wide, and those bitmaps
                some = np.flatnonzero(wide >= w)
                maps[w] = np.searchsorted(some, np.arange(len(fp))), folded([bits[x] for x in some], w)
                w *= 2

            def alike(i, j, size=size, wide=wide, narrow=narrow, maps=maps, far=far):
                most = apart * (size[i] + size[j]) + 1e-6
                good = np.flatnonzero(np.abs(far[i] - far[j]).max(1) <= most)
                good = good[np.bitwise_count(narrow[i[good]] ^ narrow[j[good]]).sum(1, dtype=np.int32) <= most[good]]
                out = np.zeros(len(i), bool)
                out[good] = True
                both = np.minimum(wide[i[good]], wide[j[good]])
                for w, (row, maps_w) in maps.items():
                    pairs = good[both == w]
                    for k in range(0, len(pairs), 2_000):
                        part = pairs[k : k + 2_000]
                        out[part] = np.bitwise_count(maps_w[row[i[part]]] ^ maps_w[row[j[part]]]).sum(1, dtype=np.int32) <= most[part]
                return out

            node, root = candidates(cell, size, similarity, alike)
            yield pa.RecordBatch.from_arrays([pa.array(fp[node]), pa.array(fp[root])], names=["a", "b"])

    near = components(by_cell(full).mapInArrow(trimmed(run), "a long, b long").distinct())
    remove(shared, keys)
    of = written(near.select("u").union(near.select("v")).distinct().withColumnRenamed("u", "fp"), "of")
    texts = written(packed_classes(docs).join(of, "fp").groupBy("fp").agg(F.min("z").alias("z"), F.min("words").alias("words")), "texts")
    star = components(verified(near, texts, shingle, similarity))
    out = written(_least_of(prints.select("doc_id", "fp"), classes.select("fp", "least"), star), "near")
    remove(prints, classes, near, of, texts, star)
    return out
