import collections
import re

import corpus_pipeline
from loglens.llm import decontaminate, simhash
from loglens.llm.common import table, written


def shingle_set(text):
    return set(simhash.shingles(simhash.split((text or "").encode()), 5))


def test_stages_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, sf), name)
        assert out.columns == docs.columns
        kept.append((name, docs.collect(), out.collect()))
        docs = out
    result = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    steps = {name: (before, after) for name, before, after in kept}

    before, after = steps["near_duplicates"]
    sets = {r.doc_id: shingle_set(r.text) for r in before}
    alike = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    ids = sorted(sets)
    left = {r.doc_id for r in after}
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if alike(a, b) >= 0.8:
                assert not {a, b} <= left
    for gone in set(ids) - left:
        assert max(alike(gone, x) for x in ids if x != gone) >= 0.8 or not sets[gone]

    before, after = steps["repeated_passages"]
    data = {r.doc_id: (r.text or "").encode() for r in before}
    n = corpus_pipeline.PASSAGE
    seen = collections.Counter(d[i : i + n] for d in data.values() for i in range(len(d) - n + 1))
    spans = {}
    for i, d in data.items():
        at = [m.span() for m in re.finditer(rb"[^ \t\n\r\x0b\x0c]+", d)]
        spans[i] = [(a, b) for (a, _), (_, b) in zip(at, at[corpus_pipeline.WORDS - 1 :])]
    holders, places = collections.defaultdict(set), collections.defaultdict(list)
    for i, d in data.items():
        for a, b in spans[i]:
            holders[d[a:b]].add(i)
            places[i, d[a:b]].append(a)
    for r in after:
        d, gone = data[r.doc_id], set()
        for a, b in spans[r.doc_id]:
            own = places[r.doc_id, d[a:b]]
            if len(holders[d[a:b]]) > 1 or max(own) - min(own) >= b - a:
                gone.update(range(a, b))
        for i in range(len(d) - n + 1):
            if seen[d[i : i + n]] > 1:
                gone.update(range(i, i + n))
        want = bytes(x for i, x in enumerate(d) if i not in gone).decode("utf-8", "ignore")
        assert r.text == want and r.n_chars == len(want)

    before, after = steps["decontamination"]
    items = [decontaminate.plain(r.text) for r in table(spark, sf, "benchmark").collect()]
    left = {r.doc_id for r in after}
    for r in before:
        if any(i in decontaminate.plain(r.text) for i in items):
            assert r.doc_id not in left
    assert len(result) == len(after)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, result))


def test_edges(spark, sf):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "a text", "en", "s", 6), (3, "words " * 5000, "en", "s", 1), (3, "words " * 5000, "en", "s", 1), (3, "other words", "en", "s", 1), (4, "a text", None, None, None)]
    docs = spark.createDataFrame(rows, table(spark, sf, "documents").schema)
    for some, most in ((docs, 4), (docs.limit(0), 0)):
        out = some
        for name, stage in corpus_pipeline.STAGES:
            out = written(stage(spark, out, sf), name)
        assert out.count() == most


def test_columns_whose_names_the_stages_use(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _text string, `_` long, `row` long, id string, raw string, hash long, fp long, z string, found string, toxic int, item_id long"
    rows = [(i, f"one text of words {i % 3} that is like two others and no more", "en", "s", 5, "t", i, i, "i", "r", 7, 8, "z", "f", 1, 2) for i in range(9)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, sf), name)
        assert out.columns == docs.columns
        assert {tuple(r)[5:] for r in out.collect()} <= {r[5:] for r in rows}
        if name == "near_duplicates":
            assert [r.doc_id for r in out.orderBy("doc_id").collect()] == [0, 1, 2]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == 9
