"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding is this module's own: a score-ordered agenda of adjacent symbol pairs. A text becomes symbols of one
character; a heap holds every adjacent pair that is a vocabulary piece, best score first and leftmost among
equals; the best pair merges, its new neighbours join the agenda, and entries whose symbols have changed since
are passed over. Symbols that are no piece fall back to their UTF-8 bytes.

No piece of a checked vocabulary goes on past a character into a following word mark (U+2581), so texts are cut
there and each worker keeps the ids of the segments that it has met lately. The agendas of segments of up to 64
characters run side by side as rows of an array, by length, which holds every pair's rank and the piece that it makes;
longer ones use a heap. Every new segment is checked against the sentencepiece library, in one call for an Arrow
batch; where pieces do go on into a mark, texts are encoded and checked whole.

Nulls encode as empty texts. An empty text has the begin and end ids alone and decodes to an empty text. Rows are
independent, so ties, repeated rows and empty tables need no rule, and columns other than the id and the text are
not looked at. A segment may be as long as the text; its agenda has at most twice as many entries as characters.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, compress
from operator import add, not_
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loglens.llm.common import trimmed

MARK = "▁"
#: Bytes of each of the two halves of a Python worker's cache of segments, what an entry takes besides its characters and ids, and the longest segment that is kept.
CACHE_BYTES, ENTRY_BYTES, CACHE_CHARS = 40 << 20, 200, 32
#: Longest segments of each group whose agendas run side by side; beyond the last, each has a heap of its own.
SIDE_BY_SIDE = (8, 16, 32, 64)
#: Numbers of characters that are no piece start here; the rank of a pair that makes no piece.
OTHER, NEVER = 1 << 24, 1 << 30


class Tokenizer:
    """A merge-type vocabulary read through the sentencepiece library."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
        ids = range(lib.vocab_size())
        self.special = {i for i in ids if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i)}
        self.piece = {lib.id_to_piece(i): i for i in ids if i not in self.special}
        order = {x: r for r, x in enumerate(sorted({lib.get_score(i) for i in self.piece.values()}, reverse=True))}
        self.rank = {p: order[lib.get_score(i)] for p, i in self.piece.items()}
        self.byte = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.cuts = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.piece)
        self.segments = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall if self.cuts else (lambda text: [text] if text else [])
        self.begin, self.end = lib.bos_id(), lib.eos_id()
        self.kept: dict[str, bytes] = {}  # by the segment without its first mark
        self.older: dict[str, bytes] = {}
        self.size = 0
        self.mark_a = len(lib.encode("a"))
        # Symbols as numbers: a piece by its id, a character that is no piece by OTHER + its code point.
        self.of_char = np.arange(0x110000, dtype=np.int32) + OTHER
        for p, i in self.piece.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        number = lambda x: self.piece.get(x, OTHER + ord(x) if len(x) == 1 else -1)
        splits = {(number(p[:k]) << 32 | number(p[k:])): (self.rank[p], i) for p, i in self.piece.items() for k in range(1, len(p)) if number(p[:k]) >= 0 <= number(p[k:])}
        self.pair_keys = np.array(sorted(splits), np.int64)
        self.pair_ranks = np.array([splits[k][0] for k in self.pair_keys.tolist()] + [NEVER], np.int32)
        self.pair_ids = np.array([splits[k][1] for k in self.pair_keys.tolist()] + [-1], np.int32)

    def merge(self, text: str) -> list[int]:
        """Ids of a text whose spaces are marks already."""
        rank, symbols, n = self.rank.get, list(text), len(text)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        pair = [*map(rank, map(add, symbols, symbols[1:])), None]
        agenda = [r << 32 | i for i, r in enumerate(pair) if r is not None]
        heapify(agenda)
        while agenda:
            best = heappop(agenda)
            i = best & 0xFFFFFFFF
            if pair[i] != best >> 32:  # a merge beside it came first
                continue
            j = after[i]
            symbols[i] = s = symbols[i] + symbols[j]
            symbols[j], pair[j] = "", None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                pair[i] = r = rank(s + symbols[k])
                if r is not None:
                    heappush(agenda, r << 32 | i)
            else:
                pair[i] = None
            h = before[i]
            if h >= 0:
                pair[h] = r = rank(symbols[h] + s)
                if r is not None:
                    heappush(agenda, r << 32 | h)
        out: list[int] = []
        for s in symbols:
            if s:
                found = self.piece.get(s)
                if found is not None:
                    out.append(found)
                else:
                    out.extend(self.byte[b] for b in s.encode())
        return out

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair among pair_ranks and pair_ids; the last one where the two make no piece."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pair_keys, key)
        at[self.pair_keys[np.minimum(at, len(self.pair_keys) - 1)] != key] = len(self.pair_keys)
        return at

    def merge_many(self, segments: list[str]) -> list[bytes]:
        """``merge`` of segments of like length, side by side: in each round every segment's agenda gives up its best pair, the leftmost of equals."""
        size = np.array([len(x) for x in segments])
        width = int(size.max()) + 1
        real = np.arange(width) < size[:, None]
        symbols = np.full((len(segments), width), -1, np.int32)
        symbols[real] = self.of_char[np.frombuffer("".join(segments).encode("utf-32-le"), "<u4")]
        pairs = np.full(symbols.shape, len(self.pair_keys), np.int32)
        inner = real[:, 1:]
        pairs[:, :-1][inner] = self.look_up(symbols[:, :-1][inner], symbols[:, 1:][inner])
        ranks = self.pair_ranks[pairs]
        out: list[bytes] = [b""] * len(segments)
        row = np.arange(len(segments))
        while len(row):
            best, every = ranks.argmin(1), np.arange(len(row))
            done = ranks[every, best] == NEVER
            if done.any():
                for k, x in zip(row[done].tolist(), self.packed(symbols[done]), strict=True):
                    out[k] = x
                keep = np.flatnonzero(~done)
                row, symbols, pairs, ranks, best = row[keep], symbols[keep], pairs[keep], ranks[keep], best[keep]
                every = np.arange(len(row))
                if not len(row):
                    break
            merged = self.pair_ids[pairs[every, best]]
            shift = np.arange(width - 1) > best[:, None]
            for x in (symbols, pairs, ranks):
                np.copyto(x[:, :-1], x[:, 1:].copy(), where=shift)
            symbols[every, best] = merged
            for at in (best, np.maximum(best - 1, 0)):
                right = symbols[every, at + 1]
                found = np.where(right < 0, len(self.pair_keys), self.look_up(symbols[every, at], right))
                pairs[every, at], ranks[every, at] = found, self.pair_ranks[found]
        return out

    def packed(self, symbols: np.ndarray) -> list[bytes]:
        real = symbols >= 0
        ends = (4 * np.cumsum(real.sum(1))).tolist()
        data = symbols[real].astype("<u4").tobytes()
        out = [data[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]
        for k in np.flatnonzero((symbols >= OTHER).any(1)).tolist():
            line = symbols[k]
            out[k] = b"".join(pack("<I", x) if x < OTHER else pack(f"<{len(y := chr(x - OTHER).encode())}I", *(self.byte[b] for b in y)) for x in line[line >= 0].tolist())
        return out

    def new(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words that aren't kept, each with the mark before it, checked against the library."""
        out, sizes = {}, np.array([len(w) + 1 for w in words])
        for low, high in zip((0, *SIDE_BY_SIDE), SIDE_BY_SIDE, strict=False):
            some = np.flatnonzero((low < sizes) & (sizes <= high)).tolist()
            for at in range(0, len(some), 20_000):
                part = [words[i] for i in some[at : at + 20_000]]
                out.update(zip(part, self.merge_many([MARK + w for w in part]), strict=True))
        for i in np.flatnonzero(sizes > SIDE_BY_SIDE[-1]).tolist():
            out[words[i]] = pack(f"<{len(x := self.merge(MARK + words[i]))}I", *x)
        # The library puts a mark before each text by itself, and drops an only one.
        theirs = self.library.encode([w.replace(MARK, " ") or f"a{MARK}" for w in words], num_threads=1)
        if "" in out:
            theirs[words.index("")] = theirs[words.index("")][self.mark_a :]
        if b"".join(map(out.__getitem__, words)) != array("I", chain.from_iterable(theirs)).tobytes() or any(len(out[w]) != 4 * len(x) for w, x in zip(words, theirs, strict=True)):
            wrong = next(w for w, x in zip(words, theirs, strict=True) if out[w] != array("I", x).tobytes())
            raise AssertionError(f"ids of {wrong[:80]!r} differ from the library's")
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, begin and end ids included."""
        get, older, cut, asked = self.kept.get, self.older.get, [], set()
        for t in texts:
            if self.cuts and "  " not in t and MARK not in t and t[:1] != " " != t[-1:]:
                words = t.split(" ") if t else []  # each follows a mark, and is none itself
            else:
                words = [s[1:] for s in self.segments(MARK + t.replace(" ", MARK))] if t else []
            ids = list(map(get, words))
            if None in ids:
                asked.update(compress(words, map(not_, ids)))
            cut.append((words, ids))
        found = {w: x for w in asked if (x := older(w)) is not None}
        if fresh := [w for w in asked if w not in found]:
            found |= self.new(fresh)
        first, last = pack("<I", self.begin), pack("<I", self.end)
        out = [b"".join([first, *(map(found.get, words, ids) if None in ids else ids), last]) for words, ids in cut]
        for w, x in found.items():
            if len(w) <= CACHE_CHARS:
                self.kept[w] = x
                self.size += ENTRY_BYTES + len(w) + len(x)
        if self.size > CACHE_BYTES:  # what isn't met again while another half fills goes
            self.older, self.kept, self.size = self.kept, {}, 0
        return out

    def decode_batch(self, ids: list[bytes]) -> list[str]:
        """The library's decode(ids) of each."""
        return [self.library.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]


_loaded: dict[str, Tokenizer] = {}


def tokenizer(model_path: str) -> Tokenizer:
    if model_path not in _loaded:
        _loaded[model_path] = Tokenizer(model_path)
    return _loaded[model_path]


def blocks(column: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Runs of a batch's texts by bytes, so that a batch of long texts needs no more memory than one of short ones."""
    start, size, out = 0, 0, []
    for i, x in enumerate(column):
        text = x.as_py() or ""
        out.append(text)
        size += len(text)
        if size >= most_bytes:
            yield start, out
            start, size, out = i + 1, 0, []
    if out:
        yield start, out


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded`` text."""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids binary, decoded string"

    def run(batches):
        t = tokenizer(model_path)
        for batch in batches:
            for start, texts in blocks(batch.column(1)):
                ids = t.encode_batch(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array(ids, pa.binary()), pa.array(t.decode_batch(ids), pa.string())], names=[id_col, "ids", "decoded"])

    return docs.select(id_col, text_col).mapInArrow(trimmed(run), schema)


def digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` reduced inside the worker to n_tokens, ids_sha256 and decoded_sha256, so that ids don't cross back to the JVM."""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        t, sha = tokenizer(model_path), hashlib.sha256
        for batch in batches:
            for start, texts in blocks(batch.column(1)):
                ids = t.encode_batch(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha(x).hexdigest() for x in ids], pa.string()), pa.array([sha(x.encode()).hexdigest() for x in t.decode_batch(ids)], pa.string())],
                    names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(id_col, text_col).mapInArrow(trimmed(run), schema)
