"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are lower-cased, and all that is no letter, digit or character beyond ASCII becomes one space.
An item of m bytes counts as held, whatever its length, where all of it stands between word boundaries but for
k = floor(m * rate) edits; items so short that k is 0 must stand exactly. Boundaries are spaces around item and text.
Cut into k + 1 pieces, one of them must stand in any such copy unchanged. One automaton finds the pieces of all items in
a pass over a text. Every hit proposes where the item would start; proposals within k of one another are one window, and
Myers' bit-parallel distance over the window decides.

The items are gathered in blocks of about ``BLOCK_BYTES`` (one block for any usual benchmark); beyond one, each block's
result is written to the shared folder and its broadcast taken back before the next. Null and empty texts, and items
without a letter or digit, match nothing; null ids are kept. Each row is searched by itself, so ties and repeated rows
give a row each and very long texts need memory for themselves alone. Empty tables give an empty result; columns other
than the ids and texts are not looked at, whatever their names.
"""

from __future__ import annotations

import math

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_type

from loglens.llm.common import trimmed, written

RATE, BLOCK_BYTES = 0.06, 8 << 20
_KEPT = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def plain(text: str | None) -> str:
    """The text as compared, one character for each UTF-8 byte."""
    return b" ".join((text or "").lower().encode().translate(_KEPT).split()).decode("latin-1")


def bounded(text: str) -> str:
    """A text as compared, or an item, with a word boundary on either side."""
    return f" {text} "


def edits(item: str, rate: float = RATE) -> int:
    """Edits that a copy of an item (as compared) may have."""
    return int(len(item) * rate)


def pieces(pattern: str, allowed: int) -> list[tuple[int, str]]:
    """The pattern cut into one piece more than it may have edits, with each piece's place."""
    n = allowed + 1
    cuts = [len(pattern) * i // n for i in range(n + 1)]
    return [(a, pattern[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str) -> list[int]:
    """The least edit distance between the pattern and any substring of the text that ends at each character (bit-parallel)."""
    m = len(pattern)
    places: dict[str, int] = {}
    for i, c in enumerate(pattern):
        places[c] = places.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, out = full, 0, m, []
    for c in text:
        eq = places.get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        across_plus = minus | (full & ~(diagonal | plus))
        across_minus = plus & diagonal
        if across_plus & top:
            score += 1
        elif across_minus & top:
            score -= 1
        across_plus = across_plus << 1 & full
        across_minus = across_minus << 1 & full
        plus = across_minus | (full & ~(diagonal | across_plus))
        minus = across_plus & diagonal
        out.append(score)
    return out


class Searcher:
    """All of some items: (item id, text) pairs."""

    def __init__(self, items: list[tuple], rate: float = RATE):
        self.patterns: list[tuple] = []  # item id, pattern, edits
        found: dict[str, list[tuple[int, int]]] = {}
        for item, text in items:
            if compared := plain(text):
                pattern, allowed = bounded(compared), edits(compared, rate)
                for at, piece in pieces(pattern, allowed):
                    found.setdefault(piece, []).append((len(self.patterns), at))
                self.patterns.append((item, pattern, allowed))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()

    def search(self, text: str):
        """(item id, end in the text as compared, distance), the best of every window that holds a match."""
        if not self.patterns or not text:
            return
        size, text = len(text), bounded(text)
        starts: dict[int, set[int]] = {}
        for end, (long, where) in self.automaton.iter(text):
            for k, at in where:
                starts.setdefault(k, set()).add(end + 1 - long - at)
        for k, proposed in starts.items():
            item, pattern, allowed = self.patterns[k]
            order = sorted(proposed)
            first = 0
            for i in range(1, len(order) + 1):
                if i == len(order) or order[i] - order[i - 1] > allowed:
                    low = max(0, order[first] - allowed)
                    scores = myers(pattern, text[low : order[i - 1] + len(pattern) + allowed])
                    best = min(scores, default=math.inf)
                    if best <= allowed:
                        yield item, min(size, low + scores.index(best)), best
                    first = i


def _blocks(benchmark: DataFrame, item_col: str, item_text: str):
    """Broadcast lists of (item id, text), each of at most about BLOCK_BYTES, and whether it is the last."""
    items = benchmark.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{item_text}`").alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / BLOCK_BYTES))
    for b in range(n):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b).collect()
        yield benchmark.sparkSession.sparkContext.broadcast([tuple(r) for r in part]), b == n - 1


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows, all columns as they are, that hold no test item."""
    at = docs.columns.index(text_col)

    def one(docs: DataFrame, held) -> DataFrame:
        def run(batches):
            searcher = Searcher(held.value, rate)
            for batch in batches:
                yield batch.filter(pa.array([next(searcher.search(plain(x.as_py())), None) is None for x in batch.column(at)], pa.bool_()))

        return docs.mapInArrow(trimmed(run), docs.schema)

    blocks = _blocks(benchmark, item_col, item_text)
    for held, last in blocks:
        docs = one(docs, held)
        if not last:
            docs = written(docs, "clean")
            held.destroy()
    return docs


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document row and item that it holds: doc_id, item_id, ``hits`` (places), ``distance`` (the least) and ``end`` (of that place, in the text as compared)."""
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()

    def one(held) -> DataFrame:
        def run(batches):
            searcher = Searcher(held.value, rate)
            for batch in batches:
                at, rows = [], []
                for i, x in enumerate(batch.column(1)):
                    by: dict = {}
                    for item, end, distance in searcher.search(plain(x.as_py())):
                        n, best = by.get(item, (0, (math.inf, 0)))
                        by[item] = n + 1, min(best, (distance, end))
                    at += [i] * len(by)
                    rows += [(item, n, *best) for item, (n, best) in by.items()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), pa.array([r[0] for r in rows], held_type), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())], names=["doc_id", "item_id", "hits", "distance", "end"]
                )

        return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(trimmed(run), f"doc_id {kind}, item_id {item_kind}, hits long, distance long, end long")

    held_type = to_arrow_type(benchmark.schema[item_col].dataType)
    out = None
    for held, last in _blocks(benchmark, item_col, item_text):
        found = one(held)
        if not last:
            found = written(found, "matches")
            held.destroy()
        out = found if out is None else out.unionByName(found)
    return out
