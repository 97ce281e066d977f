import itertools
import re

import numpy as np
import pytest
import xxhash

from loglens.llm import queries, simhash
from loglens.llm.common import table


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def brute_components(ids, prints, radius=2):
    label = {i: i for i in range(len(ids))}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j in itertools.combinations(range(len(ids)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            a, b = sorted((root(i), root(j)))
            label[b] = a
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(ids))]


def check(spark, rows):
    got = simhash.clusters(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    prints = [brute_fp(t) for _, t, _ in rows]
    want = brute_components([r[0] for r in rows], prints)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted([(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got], key=key) == sorted([(r[0], p, c) for r, p, c in zip(rows, prints, want)], key=key)


def test_edges_of_texts(spark):
    long = " ".join(f"w{i % 977}" for i in range(120_000))
    near = " ".join(f"v{i}" for i in range(3000))
    check(spark, [(5, None, "x"), (4, "", "x"), (9, " \n\t", None), (None, "A b", "x"), (3, "a B", "x"), (3, "a B", "x"), (None, "only one here now", "x"), (7, long, "x"), (8, long + " Ä", "x"), (10, near, "x"), (11, near + " more", "x"), (12, "ÄA a b", "x")])


def test_empty_table(spark):
    assert simhash.clusters(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_against_brute_force(spark, sf):
    rows = table(spark, sf, "documents").collect()
    want = brute_components([r.doc_id for r in rows], [brute_fp(r.text) for r in rows])
    got = {r.doc_id: r for r in queries.op9_simhash(spark, sf).collect()}
    assert [got[r.doc_id].component_id for r in rows] == want
    assert all(got[r.doc_id].fingerprint == f"{brute_fp(r.text):016x}" for r in rows)


@pytest.mark.parametrize("most", [2_000, 5])
def test_links_of_crowded_buckets(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "BUCKET", most)
    r = np.random.default_rng(1)
    base = int(r.integers(0, 2**63))
    prints = {base}
    for _ in range(150):
        prints.add(base ^ sum(1 << int(b) for b in r.choice(63, r.integers(0, 5), replace=False)))
    prints = sorted(prints)
    got = simhash.components(simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"))).collect()
    root = {r.u: r.v for r in got}
    assert [root.get(p, p) for p in prints] == brute_components(prints, prints)


def test_near_duplicates(spark):
    r = np.random.default_rng(2)
    word = lambda: "".join(r.choice(list("abcdefgh"), 6))
    rows, groups = [], []
    for g in range(12):
        base = [word() for _ in range(300)]
        for c in range(3):
            copy = list(base)
            for at in r.choice(300, c * 2, replace=False):
                copy[at] = word()
            rows.append((g * 3 + c, " ".join(copy)))
            groups.append(g * 3)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in rows] == groups


def brute_groups(texts, similarity=0.8):
    """Component of each text under exact Jaccard similarity of the sets of five-word shingles."""
    sets = [set(simhash.shingles(simhash.split((t or "").encode()), 5)) for t in texts]
    label = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] == sets[j] or len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) >= similarity:
            label = [label[i] if x == label[j] else x for x in label]
    return label


def partition(labels):
    groups = {}
    for i, x in enumerate(labels):
        groups.setdefault(x, set()).add(i)
    return sorted(map(sorted, groups.values()))


def check_groups(spark, texts):
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert partition([got[i] for i in range(len(texts))]) == partition(brute_groups(texts))


@pytest.mark.parametrize("chunk", [500, 7])
def test_both_sides_of_the_similarity(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk, raising=False)
    r = np.random.default_rng(3)
    word = lambda: "".join(r.choice(list("abcdefgh"), 6))
    texts = []
    for at in range(60):  # scattered edits that leave between 0.76 and 0.84 of the shingles alike
        base = [word() for _ in range(400)]
        copy = list(base)
        for place in r.choice(79, 7 + at % 5, replace=False):
            copy[place * 5] = word()
        texts += [" ".join(base), " ".join(copy)]
    check_groups(spark, texts)


def test_replaced_and_appended_blocks(spark):
    r = np.random.default_rng(4)
    word = lambda: "".join(r.choice(list("abcdefgh"), 6))
    texts = []
    for at in range(60):
        base = [word() for _ in range(400)]
        n = 20 + at  # similarity of 0.9 down to below 0.8 where a block is replaced
        cut = int(r.integers(0, 400 - n))
        copy = base[:cut] + [word() for _ in range(n)] + base[cut + n :] if at % 2 else base + [word() for _ in range(n + 30)]
        texts += [" ".join(base), " ".join(copy)]
    check_groups(spark, texts)


def test_crowds_and_common_shingles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 9)
    monkeypatch.setattr(simhash, "CHUNK", 5)
    r = np.random.default_rng(5)
    some = [f"w{i}" for i in range(40)]
    word = lambda: some[int(r.integers(0, 40))]
    line = [word() for _ in range(30)]
    texts = [None, "", "a", "A", "b c", "a b c d e f"]
    for _ in range(3):
        base = [word() for _ in range(60)]
        for c in range(40):
            copy = base + line
            for place in r.choice(60, c % 4, replace=False):
                copy[place] = word()
            texts.append(" ".join(copy))
    texts += [" ".join([word() for _ in range(int(r.integers(1, 12)))] + line[: int(r.integers(0, 31))]) for _ in range(60)]
    check_groups(spark, texts)


def test_cells_are_bounded_by_words(spark, monkeypatch):
    """Long and short copies of one text chain: the cells hold few words each, and links between them count."""
    monkeypatch.setattr(simhash, "CHUNK_WORDS", 900)
    r = np.random.default_rng(6)
    word = lambda: "".join(r.choice(list("abcdefgh"), 6))
    base = [word() for _ in range(300)]
    texts = [" ".join(base + [word() for _ in range(int(n))]) for n in r.integers(0, 110, 40)]
    texts += [" ".join(word() for _ in range(2_000)), ""]
    check_groups(spark, texts)


def test_long_sets_that_share_a_passage_stay_apart(spark):
    """Texts of several thousand words, whose bitmaps are wide: a shared passage makes no component of them, near copies of other widths do."""
    r = np.random.default_rng(8)
    word = lambda: "".join(r.choice(list("abcdefgh"), 6))
    line = [word() for _ in range(300)]
    texts = [" ".join([word() for _ in range(int(n))] + line) for n in r.integers(2_000, 4_500, 12)]
    base = texts[0].split()
    for n in (2_047, 2_049, 2_060, len(base)):  # sizes on both sides of a power of two
        cut = (base * 2)[:n]
        texts += [" ".join(cut), " ".join(cut + [word() for _ in range(n // 6)])]
    check_groups(spark, texts)


def test_bitmaps_never_exceed_the_difference():
    r = np.random.default_rng(9)
    for n, more in ((10, 3), (1_500, 700), (5_000, 400), (40_000, 9_000)):
        a = r.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate((a[more // 2 :], r.integers(0, 1 << 63, more).astype(np.uint64)))
        maps = []
        for x in (a, b):
            w = int(simhash.widths(np.array([len(x)]))[0])
            assert simhash.PARITIES <= w <= simhash.MOST_PARITIES
            maps.append(np.packbits((np.bincount((x & np.uint64(w - 1)).astype(np.int64), minlength=w) & 1).astype(np.uint8)).tobytes())
        w = min(map(len, maps)) * 8
        for width in (simhash.PARITIES, w):
            one, two = simhash.folded(maps, width)
            assert np.bitwise_count(one ^ two).sum() <= more + more // 2
