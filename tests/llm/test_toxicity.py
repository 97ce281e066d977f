import zlib

import numpy as np

from loglens.llm import queries, toxicity
from loglens.llm.common import table


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    got = queries.op2_toxicity(spark, sf).collect()
    assert len(got) == table(spark, sf, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    rows = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in rows]) >= 0.95
    precision, recall = rates(got, truth)
    assert precision >= 0.95 and recall >= 0.7


def rates(got, truth):
    """Precision and recall over the labelled rows that are held out."""
    rows = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    both = sum(p and t for p, t in rows)
    return both / max(1, sum(p for p, _ in rows)), both / max(1, sum(t for _, t in rows))


class InMemory:
    """The sums of toxicity.Votes, row by row."""

    def __init__(self, fired, given):
        self.x, self.given = fired.astype(float), given

    def counts(self):
        by = np.array([self.x[self.given == k].sum(0) for k in (0, 1)])
        return float(len(self.x)), self.x.sum(0), np.array([(self.given == k).sum() for k in (0, 1)], float), by, self.x.T @ self.x

    def posterior(self, weight, base):
        odds = base + self.x @ weight + np.where(self.given == 1, toxicity.LABEL_ODDS, 0) - np.where(self.given == 0, toxicity.LABEL_ODDS, 0)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def sums(self, weight, base, strong):
        p = self.posterior(weight, base)
        silent = self.x[:, strong].sum(1) == 0
        return p.sum(), (p**2).sum(), p @ self.x, float(silent.sum()), p[silent].sum()


def test_sums_over_all_rows_against_memory(spark):
    r = np.random.default_rng(5)
    fired = r.random((400, 7)) < [0.5, 0.1, 0.3, 0.02, 0.2, 0.0, 0.4]
    given = np.where(r.random(400) < 0.3, r.integers(0, 2, 400), np.nan)
    rows = [([int(i) for i in np.flatnonzero(f)], None if np.isnan(g) else int(g)) for f, g in zip(fired, given, strict=True)]
    votes, memory = toxicity.Votes(spark.createDataFrame(rows, "found array<int>, given int"), 7), InMemory(fired, given)
    for a, b in zip(votes.counts(), memory.counts(), strict=True):
        assert np.allclose(a, b)
    weight, strong = r.normal(size=7), r.random(7) < 0.5
    for a, b in zip(votes.sums(weight, -1.5, strong), memory.sums(weight, -1.5, strong), strict=True):
        assert np.allclose(a, b, atol=1e-5)
    a, b = toxicity.label_model(votes), toxicity.label_model(memory)
    assert all(np.allclose(a[k], b[k], atol=1e-4) for k in a)


def test_scores_against_a_plain_sum(spark):
    """A score is the logistic function of the bias and the weights of what occurs."""
    model = {"weights": {"=vile": 2.0, "2=vile": 0.5, "%=vile": 0.25, "^vil": 1.0, "=a": -0.5}, "bias": -2.0}
    rows = [(1, "Vile things"), (2, "a vile, vile village"), (3, None), (4, "a " * 500 + "vile vile")]
    want = {1: 3 - 2, 2: 2 + 0.5 + 0.25 + 1 - 0.5 - 2, 3: -2, 4: 2 + 0.5 + 1 - 0.5 - 2}
    got = {r.doc_id: r.score for r in toxicity.scored(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert all(abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-12 for i, z in want.items())


def test_long_words_are_told_apart():
    a, b = toxicity.features_of(b"x" * 64 + b"a"), toxicity.features_of(b"x" * 64 + b"b")
    assert a[0] != b[0] and a[1:] == b[1:]


def test_label_model_finds_accuracies_and_shares():
    r = np.random.default_rng(1)
    y = r.random(4000) < 0.2
    fire = lambda on, off: np.where(y, r.random(4000) < on, r.random(4000) < off)
    one, two, three = fire(0.8, 0.02), fire(0.6, 0.05), fire(0.7, 0.01)
    noise = r.random(4000) < 0.3
    votes = InMemory(np.stack([one, two, three, noise, noise], 1), np.where(np.arange(4000) < 200, y, np.nan))
    model = toxicity.label_model(votes)
    clean, toxic = model["rates"]
    assert abs(toxic[0] - 0.8) < 0.12 and abs(toxic[1] - 0.6) < 0.12 and clean[0] < 0.05  # silence is not counted, so rates come out a little low
    assert abs(toxic[3] - clean[3]) < 0.1 and model["share"][3] < 0.6 < model["share"][0] and model["alike"][3, 4] > 0.9
    assert np.mean((votes.posterior(model["weight"], model["base"]) > 0.5) == y) > 0.95


def test_edges(spark):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)] + [(3, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    rows = [(i, f"the {'rude' if i % 2 else 'kind'} word number w{i % 7}", "x", 1) for i in range(60)] + [(100, None, "x", 1), (101, "", "x", 0), (None, "rude", "x", 1), (5, "rude", "x", 1), (5, "rude", "x", 1), (102, "the rude word number " * 15_000, "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, toxic int")
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[102].predicted == 1 and by[100].score == by[101].score < 0.7 and not by[None].held_out
    none = spark.createDataFrame([], labels.schema)
    assert toxicity.classify(docs, none).count() == len(rows)
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def test_labels_of_held_out_rows_change_nothing(spark):
    rows = [(i, f"{'vile' if i % 3 == 0 else 'fine'} text {i}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    label = lambda flip: spark.createDataFrame([(i, int(i % 3 == 0) ^ (flip and zlib.crc32(str(i).encode()) % 3 == 1)) for i in range(90)], "doc_id long, toxic int")
    a, b = ({r.doc_id: r.score for r in toxicity.classify(docs, label(f)).collect()} for f in (0, 1))
    assert a == b
