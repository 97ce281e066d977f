import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from loglens.llm import queries, sentencepiece_bpe
from loglens.llm.common import table

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b   c", "▁", "▁▁x ▁", "a▁b", "\x00<s></s><unk>", "ﷺ ﬁ Å\r\n\t", "x" * 3000, "日本語" * 200, "é", "﻿ab", "\U0001f600 " * 5, "\n", "　a b", "ab" * 40 + " " + "=" * 100]


LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def want(text):
    lib = LIBRARY
    ids = lib.encode(text or "", add_bos=True, add_eos=True)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_edges(spark):
    rows = [(i if i % 5 else None, t, 3) for i, t in enumerate(ODD)] + [(1, "a", 3), (1, "a", 3)]
    got = sentencepiece_bpe.digests(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), MODEL).collect()
    assert sorted(tuple(r)[1:] for r in got) == sorted(want(t) for _, t, _ in rows)
    assert sentencepiece_bpe.digests(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0
    one = sentencepiece_bpe.encode(spark.createDataFrame([(1, "two words")], "doc_id long, text string"), MODEL).first()
    assert one.decoded == "two words" and len(one.ids) % 4 == 0


def test_agendas_agree_with_the_library(monkeypatch):
    monkeypatch.setattr(sentencepiece_bpe, "CACHE_BYTES", 5_000)
    t = sentencepiece_bpe.Tokenizer(MODEL)
    r = random.Random(3)
    texts = ["".join(r.choices("abcdeéthing ▁.,\n日 ", k=r.randint(0, 90))) for _ in range(400)]
    for batch in (texts[:200], texts[200:], texts[:50]):
        assert [np.frombuffer(x, "<u4").tolist() for x in t.encode_batch(batch)] == [t.library.encode(x, add_bos=True, add_eos=True) for x in batch]
    for x in texts[:100]:
        if x:
            marked = "▁" + x.replace(" ", "▁")
            assert t.merge(marked) == t.library.encode(x)


def test_ties_and_side_by_side_agendas():
    """Runs of marks tie in score; the arrays and the heap give the same ids for every length."""
    t = sentencepiece_bpe.Tokenizer(MODEL)
    r = random.Random(4)
    words = list({"".join(r.choices("▁▁▁aethnosié日=", k=n)) for n in range(1, 64) for _ in range(30)} | {"▁" * n for n in range(1, 64)})
    for low in range(0, len(words), 100):
        part = words[low : low + 100]
        assert [np.frombuffer(x, "<u4").tolist() for x in t.merge_many(part)] == [t.merge(w) for w in part]


def test_a_wrong_id_is_noticed(monkeypatch):
    t = sentencepiece_bpe.Tokenizer(MODEL)
    monkeypatch.setattr(t, "merge_many", lambda part: [b"\0\0\0\0"] * len(part))
    with pytest.raises(AssertionError, match="differ"):
        t.encode_batch(["some words"])


def test_query(spark, sf):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op10_sentencepiece(spark, sf).collect()}
    for r in table(spark, sf, "documents").collect():
        assert got[r.doc_id] == want(r.text)
