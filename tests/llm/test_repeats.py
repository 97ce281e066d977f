import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from loglens.llm import queries, repeats
from loglens.llm.common import table


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if len(d) else 0
        kept = bytes(x for x, g in zip(d, gone, strict=False) if not g)
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(rows, got, length):
    want = Counter((i, *x) for (i, *_), x in zip(rows, brute([r[1] for r in rows], length), strict=True))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def texts(seed):
    """Random texts over few letters with shared, nested, periodic and repeated passages."""
    r = np.random.default_rng(seed)
    word = lambda n, k=4: "".join(r.choice(list("abcdé"[:k]), n))
    shared = [word(int(r.integers(12, 60)), 5) for _ in range(6)]
    out = []
    for _ in range(60):
        parts = []
        for _ in range(int(r.integers(1, 6))):
            parts.append([word(int(r.integers(0, 40)), 5), shared[int(r.integers(0, 6))], "ab" * int(r.integers(0, 20)), "a" * int(r.integers(0, 30)), shared[0][5:]][int(r.integers(0, 5))])
        out.append("".join(parts))
    return [*out, out[0], out[1], None, "", "short"]


@pytest.mark.parametrize(("seed", "group", "piece"), [(1, 20_000, 1 << 19), (2, 3, 1 << 19), (3, 20_000, 32), (4, 5, 50)])
def test_against_brute_force(spark, monkeypatch, seed, group, piece):
    monkeypatch.setattr(repeats, "GROUP", group)
    monkeypatch.setattr(repeats, "PIECE", piece)
    rows = [(i // 2 if i % 7 else None, t, "x") for i, t in enumerate(texts(seed))]
    check(rows, repeats.digests(spark.createDataFrame(rows, "doc_id long, text string, z string"), length=12).collect(), 12)


def test_maximal_groups_against_brute_force():
    """Every set of entries that share a string through the anchor, longest on both sides, comes once with all its entries."""
    r = np.random.default_rng(11)
    for _ in range(150):
        n, size = int(r.integers(2, 9)), 2
        word = lambda: bytes(r.integers(97, 99, int(r.integers(2, 6)), np.uint8))
        head = b"ab"
        left, right = [word() for _ in range(n)], [head + word() for _ in range(n)]
        want = {}
        for p in range(6):
            for q in range(size, 8):
                if p + q >= 4:
                    by = {}
                    for i in range(n):
                        if len(left[i]) >= p and len(right[i]) >= q:
                            by.setdefault((left[i][:p], right[i][:q]), []).append(i)
                    for members in by.values():
                        if len(members) > 1:
                            want[tuple(members)] = max(want.get(tuple(members), (0, 0)), (p, q), key=sum)
        got = [(tuple(sorted(m)), (p, q)) for p, q, m in repeats.maximal(left, right, 4, size)]
        assert sorted(got) == sorted(want.items())


def test_groups_have_every_occurrence(spark):
    r = np.random.default_rng(12)
    word = lambda n: "".join(r.choice(list("abcdefgh"), n))
    once, often = word(12), word(12)
    rows = [(1, word(9) + once + word(7)), (2, once + word(20)), (3, word(5) + often), (3, word(5) + often), (4, "x" + often + "y"), (None, often), (5, word(200)), (6, None)]
    found = repeats.groups(spark.createDataFrame(rows, "doc_id long, text string"), length=12).collect()
    data = [(t or "").encode() for _, t in rows]
    by = {}
    for x in found:
        text = next(d for (i, _), d in zip(rows, data, strict=True) if i == x.doc_id and repeats.xxhash.xxh64_intdigest(d, 42) == x.text & (2**64 - 1))
        by.setdefault(x.group, {}).setdefault(text[x.start : x.end], set()).add((x.doc_id, x.text, x.start))
    assert all(len(strings) == 1 for strings in by.values())
    # Strings of the least length are in the contexts of their anchors as a whole.
    all_of = {}
    for strings in by.values():
        for s, places in strings.items():
            all_of.setdefault(s, set()).update(places)
    assert {i for i, _, _ in all_of[often.encode()]} == {3, 4, None} and len(all_of[often.encode()]) == 4
    assert {i for i, _, _ in all_of[once.encode()]} == {1, 2}


def test_clashing_names(spark):
    rows = [(i, "the same passage in each row", "u", i, "r") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `_` string, z long, `row` string")
    got = repeats.kept_texts(docs, 12)
    assert got.columns == docs.columns and {tuple(r) for r in got.collect()} == {(i, "", "u", i, "r") for i in range(3)}
    assert repeats.kept_texts(docs.select("doc_id", "text"), 12).count() == 3


def test_empty_table(spark):
    assert repeats.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    check(rows, queries.op6_repeats(spark, sf).collect(), 400)


def test_long_text_that_repeats_nothing(spark):
    r = np.random.default_rng(6)
    long = bytes(r.integers(97, 123, 1_300_000, np.uint8)).decode()
    rows = [(1, long), (2, "x" * 399), (3, long[600_000:600_500] + "y" * 300)]
    check(rows, repeats.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect(), 400)


def test_no_place_twice(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 16)
    text = bytes(np.random.default_rng(7).integers(97, 123, 3_000, np.uint8)).decode()
    places = [r.pos for r in repeats.anchors(spark.createDataFrame([(1, text)], "doc_id long, text string"), 12, "doc_id", "text").collect()]
    assert len(places) == len(set(places))


def test_passages_of_short_words(spark):
    import corpus_pipeline

    r = np.random.default_rng(8)
    words = lambda n: " ".join("".join(r.choice(list("abcdefgh"), 2)) for _ in range(n))
    over, under, alone = words(51), words(50), words(60)
    rows = [(1, "xx " + over + " yyyy", "en", "s", 0), (2, over, "en", "s", 0), (3, "zzz\n" + under + "\tq", "en", "s", 0), (4, "o " + under, "en", "s", 0), (5, alone, "en", "s", 0), (6, None, "en", "s", 0), (7, "the " * 55, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.passages(spark, docs, "").collect()}
    assert got == {1: "xx  yyyy", 2: "", 3: rows[2][1], 4: rows[3][1], 5: alone, 6: "", 7: "the " * 55}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_windows_of_words_against_brute_force(spark, seed):
    """Bytes covered by windows of 6 words and under 40 bytes that another row has, or that stand twice in a row without overlap."""
    r = np.random.default_rng(seed)
    word = lambda: "".join(r.choice(list("ab"), int(r.integers(1, 3))))
    passage = [" ".join(word() for _ in range(int(r.integers(6, 30)))) for _ in range(4)]
    rows = [(i if i % 9 else None, " ".join([*(word() for _ in range(int(r.integers(0, 12)))), passage[int(r.integers(4))], *(word() for _ in range(int(r.integers(0, 12))))])) for i in range(25)]
    rows += [rows[3], rows[3], (50, None), (51, ""), (52, "a " * 40), (53, " ".join(["abababababab"] * 9))]
    data = [(t or "").encode() for _, t in rows]
    windows = []
    for d in data:
        at = [(m.start(), m.end()) for m in re.finditer(rb"[^ \t\n\r\x0b\x0c]+", d)]
        windows.append([(a, b) for (a, _), (_, b) in zip(at, at[5:])])
    want = []
    for x, d in enumerate(data):
        gone, most = set(), set()
        for a, b in windows[x]:
            own = [p for p, q in windows[x] if d[p:q] == d[a:b]]
            if any(d[a:b] == data[y][p:q] for y in range(len(data)) if y != x for p, q in windows[y]) or max(own) - min(own) >= b - a:
                most |= set(range(a, b))
                gone |= set(range(a, b)) if b - a < 40 else set()
        want.append((rows[x][0], repeats.xxhash.xxh64_intdigest(d, 42), gone, most))
    got = {}
    for f in repeats.word_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 6, 40, "doc_id", "text").collect():
        got.setdefault((f.id, f.text & (2**64 - 1)), set()).update(range(f.start, f.end))
    for i, h, gone, most in want:  # a run may hold longer windows too, which repeat as well
        assert gone <= got.get((i, h), set()) <= most
