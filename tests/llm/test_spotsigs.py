import hashlib
import itertools

import pytest

from loglens.llm import queries, spotsigs
from loglens.llm.common import table


def brute(rows):
    """rows in order of their ids: what the query returns."""
    out = []
    for k, (i, t) in enumerate(rows):
        text, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(text) // 4
        new = text[: len(text) - n] + following[:n]
        sets = [set(spotsigs.signatures(x.encode())) for x in (text, new, following)]
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        out.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), like(sets[0], sets[1]), like(sets[0], sets[2])))
    return out


def got(df):
    return [(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in df.collect()]


def test_edges(spark):
    rows = [(None, "the first of the null kind is here"), (-5, ""), (2, None), (3, "!!!"), (4, "a"), (7, "the quick brown fox and the lazy dog " * 3000), (9, "é" * 9), (12, "one two three four")]
    df = spark.createDataFrame([(*r, "f") for r in rows], "doc_id long, text string, fingerprint string")
    assert sorted(got(spotsigs.compared(df)), key=str) == sorted(brute(rows), key=str)
    assert spotsigs.compared(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = spark.createDataFrame([(1, "the only text")], "doc_id long, text string")
    assert got(spotsigs.compared(one)) == brute([(1, "the only text")])


def test_large_ids_and_many_ranges(spark, monkeypatch):
    """Ids that doubles can't hold, and ranges of a few documents each."""
    monkeypatch.setattr(spotsigs, "RANGE_BYTES", 60)
    rows = [((1 << 60) + 3 * i, f"the text of {'x' * (i % 9)} number {i} and its words") for i in range(90)]
    rows += [(None, "nulls are first"), (None, "in the order of their texts"), (-(1 << 62), "least")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, bucket int")
    found = got(spotsigs.compared(df))
    assert len(found) == len(rows)
    order = sorted((r for r in rows if r[0] is not None))
    assert sorted(x for x in found if x[0] is not None)[:-1] == brute(order)[:-1]


def test_ids_that_are_no_integers(spark):
    with pytest.raises(TypeError, match="integer"):
        spotsigs.compared(spark.createDataFrame([("a", "text")], "doc_id string, text string"))


def test_chains_of_texts_of_every_length():
    """One rule: the start and every anchor with the two content words that follow."""
    f = spotsigs.xxhash.xxh64_intdigest

    def plain(text):
        found = spotsigs.words(text.encode())
        out = set()
        for i, w in [(-1, b""), *enumerate(found)]:
            rest = [x for x in found[i + 1 :] if x not in spotsigs.ANCHORS]
            if rest and (i < 0 or w in spotsigs.ANCHORS or f(w) % spotsigs.SOME == 0):
                out.add(f(b"%b:%b:%b" % (w, rest[0], rest[1] if len(rest) > 1 else b"")))
        return sorted(out)

    some = "the quick brown fox is on a hill and sleeps over der alte Mann und das Meer 日本 語 abc def ghi jkl mno pqr".split()
    for n in range(1, len(some) + 1):
        for at in range(0, len(some) - n, 3):
            text = " ".join(some[at : at + n])
            if any(w not in spotsigs.ANCHORS for w in spotsigs.words(text.encode())):
                assert spotsigs.signatures(text.encode()) == plain(text)
    assert spotsigs.signatures(b"") == [] and len(spotsigs.signatures(b"the of")) == len(spotsigs.signatures(b"!!")) == 1


def test_repeated_rows(spark):
    rows = [(1, "the same text here"), (1, "the same text here"), (1, "the same text here"), (2, "and the other")]
    assert sorted(got(spotsigs.compared(spark.createDataFrame(rows, "doc_id long, text string")))) == sorted(brute(rows))


def test_query(spark, sf):
    rows = sorted((r.doc_id, r.text) for r in table(spark, sf, "documents").collect())
    found = queries.op5_spotsigs(spark, sf).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in found) == brute(rows)
    prints = {}
    for r in found:
        prints.setdefault(dict(rows)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in prints.values())


@pytest.mark.parametrize("least", [0.0, 0.5, 0.8])
def test_pruned_jaccard(least):
    sets = [sorted(x) for n in range(5) for x in itertools.combinations(range(6), n)]
    for a, b in itertools.product(sets, sets):
        exact = len({*a} & {*b}) / len({*a, *b}) if a or b else 1.0
        found = spotsigs.jaccard(a, b, least)
        assert found == exact if exact >= least else found in (0.0, exact)


def test_near_duplicates(spark):
    base = [f"the w{i} of x{i} and y{i * 7}" for i in range(40)]
    texts = [" ".join(base), " ".join(base[:38]), " ".join(base[5:]), " ".join(base[20:]), "", None, "something else", " ".join(f"a q{i}" for i in range(50))]
    found = {r.doc_id: r.component_id for r in spotsigs.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [set(spotsigs.signatures((t or "").encode())) for t in texts]
    label = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if (len(sets[i] & sets[j]) / len(sets[i] | sets[j]) if sets[i] | sets[j] else 1) >= 0.8:
            label = [label[i] if x == label[j] else x for x in label]
    assert [found[i] for i in range(len(texts))] == label
