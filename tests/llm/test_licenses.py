import re

from loglens.llm import licenses, queries
from loglens.llm.common import table


def brute(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    at = sorted((i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    return len(words), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))


def key(r):
    return tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)


def check(got, rows):
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got]
    assert sorted(got, key=key) == sorted([(i, *brute(t)) for i, t in rows], key=key)


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(licenses, "PIECE", 7)
    rows = [(1, None), (2, ""), (None, "CC-BY"), (3, "cc by cc by by cc"), (3, "cc by cc by by cc"), (4, "x " * 30 + "General\nPublic  LICENSE, all rights reserved all rights"), (5, "cc"), (6, "cc éby"), (7, "general public licenses general public license"), (8, "\x00a\x7fb 9")]
    got = licenses.scan(spark, spark.createDataFrame([(*r, "l", 2) for r in rows], "doc_id long, text string, labels string, n_words int")).collect()
    check(got, rows)
    assert licenses.scan(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_notices_with_edits(spark):
    rows = [
        (1, "before it. Licensed under the Apache License, Version 2.0 after it"),
        (2, "you may not use this file except in strict compliance with the License. You may obtain one copy of the License at home"),
        (3, "the license of this file is in that version of the work"),
        (4, "Licensed under CC BY-NC 4.0."),
    ]
    got = {r.doc_id: r for r in licenses.scan(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "apache-2.0" and got[1].score == 1.0
    assert got[2].labels == "apache-2.0" and 0.7 <= got[2].score < 1
    assert got[3].labels == "" and got[3].score < 0.5
    assert got[4].base_labels == "cc-by" and got[4].labels.startswith("cc-by,cc-by-nc")


def test_query(spark, sf):
    check(queries.op8_licenses(spark, sf).collect(), [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()])
