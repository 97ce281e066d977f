"""Repeated passages by common-prefix intervals over an enhanced suffix array, spread over the cluster.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else too. Every such string holds, at a
place that its bytes alone decide (the leftmost least of its rolling hashes of ``length // 2`` bytes), an anchor; so
two equal strings meet under one anchor value, and only anchors that occur twice go on. An anchor's context is all that strings
through it can reach. Contexts that occur twice are repeats as they are and count as one entry each.

The others are dealt by anchor value, and there a suffix array is built whose entries are the anchors: sorted by what
follows, with the common prefixes of neighbours. A stack scan yields its interval tree. In each interval of common
prefix d the entries' left extensions are ordered, and their interval tree is scanned likewise: an interval of shared
left extension r whose entries go on in different ways on either side is a maximal repeat of r + d bytes, and all its
entries are its occurrences. ``groups`` returns those of ``length`` bytes or more with every occurrence, and the bytes
to remove are read from the same rows. An anchor value with over ``GROUP`` contexts is dealt into chunks, and every two
chunks meet in a task of their own; joins on an anchor value have a written table on their small side, so that
adaptive execution splits a frequent one. So nothing is capped and no task holds an unbounded group.

Where repeats of ``words`` words are asked for too, the windows of so many words that are shorter than ``length`` bytes
are counted by 128 bits of hash, all bytes from the first word to the last; longer ones hold strings of ``length`` bytes.

Texts cross the shuffle zstd-compressed. Null texts are empty; texts shorter than ``length`` keep everything; ties,
repeated rows and rows with equal or null ids are documents of their own, so each counts as the other's repeat. Very
long texts are searched piece by piece; an anchor that two pieces find counts once. Empty tables give empty results;
other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import remove, trimmed, written
from loglens.llm.simhash import by_cell, cell_numbers, mix, whole_cells

GROUP = 20_000
#: Windows of words in a run, on average.
RUN = 8
PIECE = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    with np.errstate(over="ignore"):
        base = np.full(n, _BASE, np.uint64)
        inverse = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        base[0] = inverse[0] = 1
        return np.cumprod(base), np.cumprod(inverse)


def _rolling(data: bytes, size: int) -> np.ndarray:
    up, down = _powers(1 << max(16, (len(data) - 1).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * up[: len(data)])))
        n = len(data) - size + 1
        return mix((sums[size:] - sums[:-size]) * down[:n])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Where the leftmost least of each ``width`` neighbours stands."""
    at, size = np.arange(len(values), dtype=np.int32), 1
    while size < width:
        step = min(size, width - size)
        right = values[step:] < values[:-step]
        at = np.where(right, at[step:], at[:-step])
        values = np.where(right, values[step:], values[:-step])
        size += step
    return at


def select(data: bytes, ends: list[int], length: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor places and values of texts that stand in ``data`` one after another and end at ``ends``."""
    values = _rolling(data, size)
    least = _least(values, length - size + 1)
    starts = [0, *ends[:-1]]
    found = [np.unique(least[a : b - length + 1]) for a, b in zip(starts, ends, strict=True) if b - a >= length]
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.uint64)
    at = np.concatenate(found)
    return at, values[at]


def _rows(batch) -> list[tuple[int, bytes]]:
    return [(i, x.as_py() or b"") for i, x in enumerate(batch.column(1).cast(pa.binary()))]


def _pieces(rows, length: int, most: int):
    """Lists of (row, first byte, piece) of some ``most`` bytes; pieces of a long text overlap by what a string may need."""
    out, size = [], 0
    for i, text in rows:
        for a in range(0, max(1, len(text) - length + 1), most):
            if len(text) >= length:
                piece = text[a : a + most + length - 1]
                out.append((i, a, piece))
                size += len(piece)
                if size >= most:
                    yield out
                    out, size = [], 0
    if out:
        yield out


def anchors(docs: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    """id, text hash, anchor place, bytes of the text, anchor value, hash of the context."""
    size, most = length // 2, PIECE
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        f = xxhash.xxh64_intdigest
        for batch in batches:
            rows = _rows(batch)
            hashes = [f(t, 42) for _, t in rows]
            last = (-1, -1)
            for pieces in _pieces(rows, length, most):
                data = b"".join(p for _, _, p in pieces)
                ends = np.cumsum([len(p) for _, _, p in pieces])
                at, value = select(data, ends.tolist(), length, size)
                piece = np.searchsorted(ends, at, "right")
                first = np.concatenate(([0], ends[:-1]))[piece]
                of = np.array([i for i, _, _ in pieces], np.int64)[piece]
                pos = at - first + np.array([a for _, a, _ in pieces], np.int64)[piece]
                # The last window of a piece and the first of the next may pick one place; places of a text only rise.
                fresh = (of != np.append(last[0], of[:-1])) | (pos != np.append(last[1], pos[:-1])) if len(of) else np.zeros(0, bool)
                of, pos, value = of[fresh].tolist(), pos[fresh].tolist(), value[fresh]
                if of:
                    last = (of[-1], pos[-1])
                context = []
                for i, p in zip(of, pos, strict=True):
                    start = max(0, p + size - length)
                    context.append(f(rows[i][1][start : p + length], p - start))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(of, pa.int64())), pa.array(np.array([hashes[i] for i in of], np.uint64).view(np.int64)), pa.array(pos, pa.int32()), pa.array([len(rows[i][1]) for i in of], pa.int32()), pa.array(value.view(np.int64)), pa.array(np.array(context, np.uint64).view(np.int64))],
                    names=["id", "text", "pos", "bytes", "v", "t"],
                )

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(trimmed(run), f"id {kind}, text long, pos int, bytes int, v long, t long")


def word_repeats(docs: DataFrame, words: int, length: int, id_col: str, text_col: str) -> DataFrame:
    """id, text hash, start and end of windows of ``words`` words and less than ``length`` bytes that occur in another row or, apart from itself, in their own; a run of windows may be one span.

    Neighbouring windows, longer ones too, are runs that end where the hash of the next window's first bytes says so, so
    that texts with a common passage have the runs within it in common. A run that two texts have is one row, all of whose
    windows repeat; only the short windows of other runs are looked up one by one, equal ones of a run once.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    white = np.zeros(256, bool)
    white[list(b" \t\n\r\x0b\x0c")] = True

    def run(batches):
        f = xxhash.xxh64_intdigest
        for batch in batches:
            of, texts, starts, ends, k1, k2, one, windows = [], [], [], [], [], [], [], []
            for i, data in _rows(batch):
                inside = np.concatenate(([False], ~white[np.frombuffer(data, np.uint8)], [False]))
                edges = np.flatnonzero(inside[1:] != inside[:-1])
                first, last = edges[::2][: max(0, len(edges) // 2 - words + 1)], edges[1::2][words - 1 :]
                short = np.flatnonzero(last - first < length)
                if not len(short):
                    continue
                begins = _rolling(data, 8)[first] % np.uint64(RUN) == 0
                begins[0] = True
                numbers = np.cumsum(begins) - 1
                kept = np.unique(numbers[short])
                low = np.flatnonzero(begins)[kept]
                high = np.append(np.flatnonzero(begins)[1:], len(first))[kept] - 1
                text, seen, runs = f(data, 42), {}, {}
                of += [i] * len(kept)
                texts += [text] * len(kept)
                starts += first[low].tolist()
                ends += last[high].tolist()
                number, base = numbers[short].tolist(), len(windows)
                windows += [{} for _ in kept]
                row = -1
                for k, (a, b) in enumerate(zip(first[short].tolist(), last[short].tolist(), strict=True)):
                    row += k == 0 or number[k] != number[k - 1]
                    key = f(data[a:b], 1), f(data[a:b], 2)
                    earliest = seen.setdefault(key, a)
                    held = windows[base + row].setdefault(key, [0, False, []])
                    held[0] |= earliest == a
                    held[1] |= a - earliest >= b - a
                    if held[2] and a <= held[2][-1][1]:
                        held[2][-1] = held[2][-1][0], b
                    else:
                        held[2].append((a, b))
                for r in range(len(k1), len(of)):
                    key = f(data[starts[r] : ends[r]], 3), f(data[starts[r] : ends[r]], 4)
                    k1.append(key[0])
                    k2.append(key[1])
                    one.append(int(runs.setdefault(key, r) == r))
            long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            flat = [(key, x) for held in windows for key, x in held.items()]
            places = [p for _, x in flat for p in x[2]]
            ends_of = lambda sizes: pa.array(np.cumsum([0, *sizes]).astype(np.int32))
            spans = pa.ListArray.from_arrays(ends_of([len(x[2]) for _, x in flat]), pa.StructArray.from_arrays([pa.array([p[0] for p in places], pa.int32()), pa.array([p[1] for p in places], pa.int32())], ["start", "end"]))
            each = pa.StructArray.from_arrays([long([k[0] for k, _ in flat]), long([k[1] for k, _ in flat]), pa.array([int(x[0]) for _, x in flat], pa.int32()), pa.array([x[1] for _, x in flat], pa.bool_()), spans], ["k1", "k2", "one", "again", "spans"])
            lists = pa.ListArray.from_arrays(ends_of(map(len, windows)), each)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), long(texts), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), long(k1), long(k2), pa.array(one, pa.int32()), lists], names=["id", "text", "start", "end", "r1", "r2", "one", "windows"])

    schema = f"id {kind}, text long, start int, end int, r1 long, r2 long, one int, windows array<struct<k1:long,k2:long,one:int,again:boolean,spans:array<struct<start:int,end:int>>>>"
    found = written(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(trimmed(run), schema), "windows")
    runs = written(found.groupBy("r1", "r2").agg(F.sum("one").alias("n")).filter("n > 1").select("r1", "r2"), "runs")
    single = found.select(F.inline("windows"))
    shared = written(single.groupBy("k1", "k2").agg(F.sum("one").alias("n"), F.max("again").alias("again")).filter("n > 1 or again").select("k1", "k2"), "values")
    rest = found.join(runs, ["r1", "r2"], "left_anti").select("id", "text", F.inline("windows"))
    return found.join(runs, ["r1", "r2"]).select("id", "text", "start", "end").unionByName(rest.join(shared, ["k1", "k2"]).select("id", "text", F.inline("spans")))


def packed(docs: DataFrame, id_col: str, text_col: str, carry: list[str] = ()) -> DataFrame:
    """id, text hash, the zstd-compressed text, and the columns to carry as a struct ``row`` (true without any)."""
    kind = docs.schema[id_col].dataType.simpleString()
    rest = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t"), (F.struct(*(F.col(f"`{c}`") for c in carry)) if carry else F.lit(True)).alias("row"))

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            rows = _rows(batch)
            for a in range(0, len(rows), 500):
                part = rows[a : a + 500]
                hashes = pa.array(np.array([xxhash.xxh64_intdigest(t, 42) for _, t in part], np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(part)), hashes, pa.array([press.compress(t) for _, t in part], pa.binary()), batch.column(2).slice(a, len(part))], names=["id", "text", "z", "row"])

    return rest.mapInArrow(trimmed(run), f"id {kind}, text long, z binary, row {rest.schema['row'].dataType.simpleString()}")


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


def intervals(lcp: list[int], least: int):
    """(common prefix, first, last) of every interval of at least ``least`` in the interval tree; lcp[i] is that of entries i - 1 and i."""
    stack = [(0, 0)]
    for i in range(1, len(lcp) + 1):
        now = lcp[i] if i < len(lcp) else 0
        low = i - 1
        while stack and stack[-1][0] > now:
            depth, low = stack.pop()
            if depth >= least:
                yield depth, low, i - 1
        if not stack or stack[-1][0] < now:
            stack.append((now, low))


def maximal(left: list[bytes], right: list[bytes], length: int, size: int):
    """(bytes to the left, bytes from the anchor on, entries) of every maximal repeat of at least ``length`` bytes.

    left holds what precedes each entry, last byte first; right holds what follows.
    """
    order = sorted(range(len(right)), key=right.__getitem__)
    rank = [0] * len(left)
    for k, i in enumerate(sorted(range(len(left)), key=left.__getitem__)):
        rank[i] = k
    lcp = [0, *(common(right[a], right[b]) for a, b in zip(order, order[1:], strict=False))]
    for depth, low, high in intervals(lcp, size):
        part, n = {}, 0  # by entry, the stretch of the interval between places of common prefix depth that it is in
        for k in range(low, high + 1):
            n += k > low and lcp[k] == depth
            part[order[k]] = n
        members = sorted(part, key=rank.__getitem__)
        shared = [0, *(common(left[a], left[b]) for a, b in zip(members, members[1:], strict=False))]
        for reach, a, b in [(0, 0, len(members) - 1), *intervals(shared, 1)]:
            if reach + depth >= length and (reach or min(shared[1:]) == 0):
                found = members[a : b + 1]
                if any(part[i] != part[found[0]] for i in found):
                    yield reach, depth, found


def occurrences(docs: DataFrame, length: int, id_col: str, text_col: str, z: DataFrame, every: bool = False) -> DataFrame:
    """``group`` (a hash of the repeated bytes), ``id``, ``text`` (a hash of the text), ``start``, ``end`` of repeats.

    z: what ``packed`` returns. every: all entries of every group, for each of the equal contexts that they stand for;
    without, an entry's longest reaches alone, with no group, and none for contexts that are repeats as a whole.
    """
    size = length // 2
    found = written(anchors(docs, length, id_col, text_col), "anchors")
    shared = written(found.groupBy("v").agg(F.count("*").alias("n")).filter("n > 1").select("v"), "values")
    hits = written(found.join(shared, "v").repartition("id", "text", "pos"), "shared")  # else a frequent value lies in few files, and reading them again can't split it
    remove(found, shared)
    kinds = hits.groupBy("v", "t").agg(F.count("*").alias("n"), F.min(F.struct("id", "text", "pos")).alias("first"))
    kinds = written(kinds, "contexts")
    start, end = F.greatest(F.lit(0), F.col("pos") + (size - length)), F.least(F.col("bytes"), F.col("pos") + length)
    twice = written(kinds.filter("n > 1").select("v", "t"), "twice")
    whole = hits.join(twice, ["v", "t"]).select(F.xxhash64("v", "t").alias("group"), "id", "text", start.cast("int").alias("start"), end.cast("int").alias("end"))

    single = written(kinds.groupBy("v").agg(F.count_if(F.col("n") == 1).alias("single"), F.ceil(F.count("*") / GROUP).cast("long").alias("chunks")).filter("single > 0").select("v", "chunks"), "values")
    entries = kinds.join(single, "v")
    asked = entries.select("first.*", "v", "t", "chunks", (F.col("n") == 1).alias("single")).groupBy("id", "text").agg(F.collect_list(F.struct("pos", "v", "t", "chunks", "single")).alias("at"))
    asked = written(asked.withColumnRenamed("id", "id2").withColumnRenamed("text", "text2"), "asked")
    both = z.join(asked, F.col("id").eqNullSafe(F.col("id2")) & (F.col("text") == F.col("text2"))).select("id", "text", "z", "at")
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["v", "lo", "hi", "id", "text", "pos", "t", "single", "left", "right"]

    def cut(batches):
        opened = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for id, text, packed_text, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = opened.decompress(packed_text)
                for x in at:
                    p, chunks = x["pos"], x["chunks"]
                    mine = hash((text, p)) % chunks
                    left, right = data[max(0, p + size - length) : p][::-1], data[p : p + length]
                    out += [(x["v"], min(mine, o), max(mine, o), id, text, p, x["t"], x["single"], left, right) for o in range(chunks)]
                if len(out) > 4_000:
                    yield _contexts(out, batch)
                    out = []
            yield _contexts(out, batch)

    def _contexts(out, batch):
        kinds = [pa.int64(), pa.int64(), pa.int64(), batch.schema.field(0).type, pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    def scan(batches):
        for table in whole_cells(batches, len(names)):
            ends = np.append(np.flatnonzero(np.diff(cell_numbers(table))) + 1, len(table)).tolist()
            single, left, right = table.column("single").to_numpy(), table.column("left"), table.column("right")
            group, at, reach, depth, a = [], [], [], [], 0
            for b in ends:
                if b - a > 1:
                    before, after, longest = left.slice(a, b - a).to_pylist(), right.slice(a, b - a).to_pylist(), {}
                    for p, q, members in maximal(before, after, length, size):
                        if every:
                            at += [a + i for i in members]
                            group += [xxhash.xxh64_intdigest(before[members[0]][:p][::-1] + after[members[0]][:q], 3)] * len(members)
                            reach += [p] * len(members)
                            depth += [q] * len(members)
                        else:
                            for i in members:
                                if single[a + i] and q > longest.get((i, p), 0):
                                    longest[i, p] = q
                    for (i, p), q in longest.items():
                        at.append(a + i)
                        group.append(0)
                        reach.append(p)
                        depth.append(q)
                    if len(at) > 100_000:
                        yield _found(table, group, at, reach, depth)
                        group, at, reach, depth = [], [], [], []
                a = b
            yield _found(table, group, at, reach, depth)

    def _found(table, group, at, reach, depth):
        rows = table.select(["id", "text", "v", "t", "pos"]).take(pa.array(at, pa.int64())).combine_chunks()
        place = rows.column("pos").to_numpy()
        columns = [pa.array(np.array(group, np.uint64).view(np.int64)), rows.column("id"), rows.column("text"), pa.array(place - np.array(reach, np.int32)), pa.array(place + np.array(depth, np.int32)), *([rows.column(c) for c in ("v", "t", "pos")] if every else [])]
        found = pa.table(columns, names=["group", "id", "text", "start", "end", *(["v", "t", "pos"] if every else [])]).combine_chunks().to_batches()
        return found[0] if found else pa.RecordBatch.from_arrays([pa.array([], c.type) for c in columns], names=["group", "id", "text", "start", "end", *(["v", "t", "pos"] if every else [])])

    cells = by_cell(both.mapInArrow(trimmed(cut), f"v long, lo long, hi long, id {kind}, text long, pos int, t long, single boolean, left binary, right binary"), "v")
    schema = f"group long, id {kind}, text long, start int, end int"
    parts = cells.mapInArrow(trimmed(scan), schema + (", v long, t long, pos int" if every else ""))
    if every:  # each of the equal contexts is an occurrence, where it stands
        parts = parts.distinct().withColumnsRenamed({"id": "_id", "text": "_text"}).withColumnsRenamed({"pos": "_pos"}).join(hits.select("v", "t", "id", "text", "pos"), ["v", "t"])
        parts = parts.select("group", "id", "text", (F.col("start") - F.col("_pos") + F.col("pos")).alias("start"), (F.col("end") - F.col("_pos") + F.col("pos")).alias("end"))
    return whole.unionByName(parts)


def groups(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal repeats of ``length`` bytes or more as far as their anchors' contexts reach: ``group`` (a hash of the bytes), id, ``text`` (a hash of the text), ``start`` and ``end`` of every occurrence."""
    return occurrences(docs, length, id_col, text_col, packed(docs, id_col, text_col), every=True).distinct().withColumnRenamed("id", id_col)


def spans(docs: DataFrame, length: int, id_col: str, text_col: str, z: DataFrame, words: int | None = None) -> DataFrame:
    """``id``, ``text`` (a hash of the text) and ``spans``: start and end byte of repeated passages, which may overlap; at most one for each place where one starts.

    Passages count from ``length`` bytes on and, where ``words`` is given, from so many words on too. z: see occurrences.
    """
    found = occurrences(docs, length, id_col, text_col, z).drop("group")
    if words:
        found = found.unionByName(word_repeats(docs, words, length, id_col, text_col))
    longest = found.groupBy("id", "text", "start").agg(F.max("end").alias("end"))
    return longest.groupBy("id", "text").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def joined_spans(found) -> list[tuple[int, int]]:
    """Sorted spans as maximal runs."""
    out: list[tuple[int, int]] = []
    for x in found:
        start, end = x["start"], x["end"]
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def kept_bytes(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for run in runs for x in run), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def with_spans(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", carry: list[str] = (), words: int | None = None) -> DataFrame:
    """Every row's ``id``, compressed text ``z``, ``spans`` (null where nothing repeats) and carried columns ``row``."""
    z = packed(docs, id_col, text_col, carry)
    found = spans(docs, length, id_col, text_col, packed(docs, id_col, text_col), words).withColumnRenamed("id", "id2").withColumnRenamed("text", "text2")
    return z.join(found, F.col("id").eqNullSafe(F.col("id2")) & (F.col("text") == F.col("text2")), "left").select("id", "z", "spans", "row")


def digests(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans and kept_sha256."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        opened = zstandard.ZstdDecompressor()
        for batch in batches:
            sizes, removed, counts, shas = [], [], [], []
            for z, found in zip(batch.column(1), batch.column(2), strict=True):
                data = opened.decompress(z.as_py())
                runs = joined_spans(found.as_py() or [])
                kept = kept_bytes(data, runs)
                sizes.append(len(data))
                removed.append(len(data) - len(kept))
                counts.append(len(runs))
                shas.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(shas, pa.string())], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_spans(docs, length, id_col, text_col).mapInArrow(trimmed(run), f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def kept_texts(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", words: int | None = None) -> DataFrame:
    """The rows with repeated passages (see spans) taken out of their text; characters that a passage cuts through go with it. Null texts become empty."""
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    found = with_spans(docs, length, id_col, text_col, others, words)
    row = found.schema["row"].dataType.simpleString()

    def run(batches):
        opened = zstandard.ZstdDecompressor()
        for batch in batches:
            out = [kept_bytes(opened.decompress(z.as_py()), joined_spans(s.as_py() or [])).decode("utf-8", "ignore") for z, s in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), batch.column(3)], names=["id", "kept", "row"])

    kept = found.mapInArrow(trimmed(run), f"id {docs.schema[id_col].dataType.simpleString()}, kept string, row {row}")
    return kept.select(*[F.col("id").alias(c) if c == id_col else F.col("kept").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
