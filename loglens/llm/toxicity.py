"""Toxicity by weak supervision.

Voters are lexicon words in four languages, patterns, and words and word beginnings that a bounded sample of labelled
rows suggests. A generative model of their votes is fitted by expectation-maximisation: each voter has a rate of
firing on toxic and on clean texts (its accuracy) and abstains where it doesn't fire, and voters that agree beyond what
the class explains share their weight (their correlations, from the residuals given the class). It is fitted to the
votes of all rows that are not held out: equal sets of votes are counted together, and a round of the algorithm is one
sum over that table. Labels only pull the posterior of their own rows. A linear classifier over words and word
beginnings, trained on the posteriors, scores every whole text.

Labels are taken only from rows whose crc32(doc_id as text) mod 3 is not 1, at most ``LABELLED`` of them, in the order
of a hash of the id. The classifier is trained on the rows that have those labels and on about ``SAMPLE`` others of that
kind, chosen by a hash of the id, which the label model has labelled; one row of an id. Neither bound touches the label
model's counts or scoring. Labels, language, source and id are no inputs of a score.

Null and empty texts have the score of a text without features. A null id is not held out and has no label; a label
that is null is none; of several labels of an id the greatest holds. Repeated rows have equal scores; without any
label the lexicon alone votes; an empty table gives an empty result. Other columns are not looked at, whatever their
names. Words beyond 64 characters are known by a hash of the whole word.
"""

from __future__ import annotations

import re
from collections import Counter
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import remove, trimmed, written

LABELLED, SAMPLE = 8_000, 4_000
VOTERS, FEATURES = 256, 512
BEGINNINGS = (3, 4, 5, 6, 7)
THRESHOLD = 0.7
#: Residual correlation from which voters share their weight; log odds that a label adds to its row.
REDUNDANT, LABEL_ODDS = 0.6, 5.0
#: Insults by language (English, German, French, Spanish).
LEXICON = (
    "idiot idiots stupid moron morons loser losers scum trash worthless pathetic disgusting clown dumb dumbass jerk filth filthy garbage "
    "imbecile fool ugly vermin retard bastard bitch asshole shit fuck fucking crap hate "
    "dumm dumme dummkopf trottel versager abschaum wertlos widerlich erbärmlich arschloch scheiße depp vollidiot "
    "stupide crétin ordure pathétique dégoûtant raclure connard salaud merde imbécile nul débile "
    "idiota estúpido estúpida imbécil basura escoria patético asqueroso inútil payaso perdedor mierda pendejo"
).split()
PATTERNS = {
    "you are": re.compile(r"\byou(?: are|'re|r)? (?:an? |such an? |so )?(?:idiot|stupid|moron|loser|scum|trash|worthless|pathetic|disgusting|clown|dumb)"),
    "shut up": re.compile(r"\bshut (?:the \w+ )?up\b"),
    "go away": re.compile(r"\b(?:go to hell|drop dead|kill yourself|get lost)\b"),
    "shouting": re.compile(r"!{3,}"),
}
_KEPT = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def held_out(id_col: str):
    """Whether crc32 of the id as text leaves a remainder of 1; not for null ids."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_KEPT).split()


def features_of(word: bytes) -> list[str]:
    """The word, and beginnings of 3 to 7 characters of it."""
    w = word.decode("utf-8", "replace")
    return [f"={w}" if len(w) <= 64 else f"#{blake2b(word, digest_size=16).hexdigest()}", *(f"^{w[:k]}" for k in BEGINNINGS if len(w) >= k)]


def features(found: list[bytes], known=features_of) -> list[str]:
    """A text's features: what occurs, what occurs twice (2), and what is a hundredth of all words at least, twice or more (%)."""
    counts: dict[str, int] = {}
    for w, n in Counter(found).items():
        for f in known(w):
            counts[f] = counts.get(f, 0) + n
    dense = max(2, len(found) / 100)
    return [x for f, n in counts.items() for x in ((f, f"2{f}", f"%{f}") if n >= dense else (f, f"2{f}") if n > 1 else (f,))]


def counted(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Per feature the labelled texts that have it, and the toxic ones; counted within a task first. docs: id, text; known: id, toxic, bounded."""

    def run(batches):
        all_of, toxic = Counter(), Counter()
        for batch in batches:
            for x, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = features(tokens(x.as_py()))
                all_of.update(found)
                if label:
                    toxic.update(found)
        names = list(all_of)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([all_of[x] for x in names], pa.int64()), pa.array([toxic[x] for x in names], pa.int64())], names=["feature", "n", "toxic"])

    texts = docs.join(F.broadcast(known), "id").select("text", "toxic")
    return texts.mapInArrow(trimmed(run), "feature string, n long, toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def chosen(counts: DataFrame, clean: int, toxic: int) -> tuple[list[str], list[str]]:
    """Voters that labels suggest, and features for the classifier: a bounded number of each."""
    base = (toxic + 1) / (clean + toxic + 2)
    rate = (F.col("toxic") + base) / (F.col("n") + 1)
    seen = counts.filter("n >= 2")
    voters = seen.filter((F.col("toxic") >= max(2, toxic // 200)) & (rate >= max(0.6, min(0.9, 4 * base)))).orderBy(F.desc("toxic"), "n", "feature").limit(VOTERS)
    expected = F.col("n") * base
    strange = F.pow(F.col("toxic") - expected, 2) / (expected * (1 - base))
    best = seen.filter(F.col("n") >= max(3, toxic // 50)).orderBy(F.desc(strange), "feature").limit(FEATURES)
    return [r.feature for r in voters.select("feature").collect()], [r.feature for r in best.select("feature").collect()]


class Known:
    """Which of some features each word has; remembers words."""

    def __init__(self, features):
        self.base = {f.lstrip("2%") for f in features}
        self.kept: dict[bytes, tuple] = {}

    def __call__(self, word: bytes) -> tuple:
        f = self.kept.get(word)
        if f is None:
            if len(self.kept) > 100_000:
                self.kept.clear()
            f = self.kept[word] = tuple(x for x in features_of(word) if x in self.base)
        return f


def votes(text: str | None, index: dict[str, int], size: int, known=features_of) -> tuple[list[int], list[int]]:
    """Indices of a text's features among ``index``, and of its patterns from ``size`` on. known: a Known of the index."""
    lowered = (text or "").lower()
    found = sorted({index[f] for f in features(tokens(text), known) if f in index})
    return found, [size + k for k, p in enumerate(PATTERNS.values()) if p.search(lowered)]


class Votes:
    """Sums over the votes of all rows: ``found`` (places of the voters that fire) and ``given`` (a label or null)."""

    def __init__(self, votes: DataFrame, size: int):
        self.rows = written(votes.groupBy("found", "given").agg(F.count("*").alias("n")), "patterns")
        self.size = size

    def counts(self) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows; per voter, rows on which it fires; labelled rows by label, and per voter too; rows on which two voters fire."""
        size = self.size

        def run(batches):
            pairs = np.zeros((size, size), np.int64)
            for batch in batches:
                n = batch.column(1).to_numpy()
                for at in range(0, len(n), 4_000):
                    lists = batch.column(0).slice(at, 4_000)
                    x = np.zeros((len(lists), size))
                    x[np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()] = 1
                    pairs += np.rint(x.T @ (x * n[at : at + 4_000, None])).astype(np.int64)
            i, j = np.nonzero(pairs)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(pairs[i, j])], names=["i", "j", "n"])

        pairs = np.zeros((size, size))
        for r in self.rows.select("found", "n").mapInArrow(trimmed(run), "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
            pairs[r.i, r.j] = r.n
        total, known, by_label = 0.0, np.zeros(2), np.zeros((2, size))
        for r in self.rows.select(F.explode(F.concat("found", F.array(F.lit(-1)))).alias("i"), "given", "n").groupBy("i", "given").agg(F.sum("n").alias("n")).collect():
            if r.i < 0:
                total += r.n
                if r.given is not None:
                    known[r.given] = r.n
            elif r.given is not None:
                by_label[r.given, r.i] = r.n
        return total, np.diag(pairs).copy(), known, by_label, pairs

    def sums(self, weight: np.ndarray, base: float, strong: np.ndarray) -> tuple[float, float, np.ndarray, float, float]:
        """Of the posteriors p: the sum, that of their squares, per voter that where it fires; and of rows without strong voters the number and the sum."""
        weights, marks = F.lit(weight.tolist()), F.lit(strong.tolist())
        odds = F.aggregate("found", F.lit(base), lambda a, i: a + F.get(weights, i))
        odds = odds + F.when(F.col("given") == 1, LABEL_ODDS).when(F.col("given") == 0, -LABEL_ODDS).otherwise(0.0)
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), odds))))
        silent = ~F.exists("found", lambda i: F.get(marks, i))
        one = 1 << 30  # whole numbers, so that the order of summing decides nothing
        whole = lambda x: F.sum(F.round(x * one).cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)")).cast("double")
        places = F.concat("found", F.array(F.lit(-1)), F.when(silent, F.array(F.lit(-2))).otherwise(F.array().cast("array<int>")))
        px, of = np.zeros(self.size), {-1: (0.0, 0.0, 0.0), -2: (0.0, 0.0, 0.0)}
        for r in self.rows.select(p.alias("p"), "n", F.explode(places).alias("i")).groupBy("i").agg(F.sum("n").alias("n"), whole(F.col("p")).alias("p"), whole(F.col("p") * F.col("p")).alias("p2")).collect():
            if r.i < 0:
                of[r.i] = (float(r.n), r.p / one, r.p2 / one)
            else:
                px[r.i] = r.p / one
        return of[-1][1], of[-1][2], px, of[-2][0], of[-2][1]


def label_model(votes, rounds: int = 25) -> dict[str, np.ndarray]:
    """``weight`` of each voter's firing and ``base``, as log odds; ``rates`` of firing on clean and toxic rows; ``share``, what correlation leaves of a weight, and ``alike``, the correlations.

    votes: see Votes.
    """
    n, fires, known, by_label, pairs = votes.counts()
    if known.sum():  # labels alone start it
        mean, rest = known[1] / known.sum(), n - known.sum()
        p, p2, px = known[1] + mean * rest, known[1] + mean**2 * rest, by_label[1] + mean * (fires - by_label.sum(0))
        total, fired, quiet = known, by_label, (known[1] / 2 + 0.5) / (known.sum() + 5)
    else:  # one voter makes a text more likely toxic than not
        quiet = 0.1
        p, p2, px, _, _ = votes.sums(np.full(len(fires), 2.5), np.log(quiet / (1 - quiet)), np.ones(len(fires), bool))
        total, fired = np.array([n - p, p]), np.stack((fires - px, px))
    weight, base = np.zeros(len(fires)), 0.0
    for _ in range(rounds):
        prior = (fires + 0.5) / (n + 1)
        rates = np.clip((fired + prior * 2) / (total[:, None] + 2), 1e-4, 1 - 1e-4)
        # Correlation of what the class leaves unexplained: a row's expected vote is clean rate + p * gap.
        clean, gap = rates[0], rates[1] - rates[0]
        mixed = np.outer(fires, clean) + np.outer(px, gap)
        rest = pairs - mixed - mixed.T + n * np.outer(clean, clean) + p * (np.outer(clean, gap) + np.outer(gap, clean)) + p2 * np.outer(gap, gap)
        spread = np.sqrt(np.maximum(np.diag(rest), 0) / max(n, 1)) + 1e-9
        alike = np.abs(rest / max(n, 1) / np.outer(spread, spread))
        np.fill_diagonal(alike, 0)
        share = 1 / (1 + np.where(alike > REDUNDANT, alike, 0).sum(1))
        # A voter that doesn't fire abstains: its silence says little, as each language has voters of its own.
        for_toxic = np.log(rates[1] / rates[0])
        before, weight, base = (weight, base), for_toxic * share, float(np.log(quiet / (1 - quiet)))
        if np.abs(weight - before[0]).max(initial=0) < 0.05 and abs(base - before[1]) < 0.05:
            break
        p, p2, px, silent, toxic = votes.sums(weight, base, for_toxic > 1)
        quiet = (toxic + 0.5) / (silent + 5)
        total, fired = np.array([n - p, p]), np.stack((fires - px, px))
    return {"weight": weight, "base": base, "rates": rates, "share": share, "alike": alike}


def linear(x: np.ndarray, target: np.ndarray, ridge: float = 0.3, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression on soft labels, by Newton steps."""
    x = np.concatenate((x, np.ones((len(x), 1))), 1).astype(np.float32)
    w = np.zeros(x.shape[1])
    w[-1] = np.log((target.sum() + 0.5) / ((1 - target).sum() + 0.5))
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - target) + keep * w
        curve = (x * (p * (1 - p) + 1e-6)[:, None].astype(np.float32)).T @ x
        step = np.linalg.solve(curve.astype(np.float64) + np.diag(keep), slope)
        step *= min(1.0, 4.0 / (np.abs(step).max() + 1e-9))
        w = w - step
        if np.abs(step).max() < 1e-3:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """``weights`` by feature, ``bias``, and ``voters`` with their rates and shares."""
    rows = docs.filter(~held_out(id_col)).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    known = labels.filter(~held_out(id_col)).groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max("toxic").cast("int").alias("toxic")).filter("toxic is not null and id is not null").orderBy(F.xxhash64("id"), "id").limit(LABELLED)
    known = written(known, "labels")
    clean, toxic = known.agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).first()
    induced, best = [], []
    if clean + toxic:
        counts = written(counted(rows, known), "features")
        induced, best = chosen(counts, clean, toxic)
        remove(counts)
    names = list(dict.fromkeys([*(f"={w}" for w in LEXICON), *induced, *best]))
    index = {f: i for i, f in enumerate(names)}
    n_voters = len(dict.fromkeys([*(f"={w}" for w in LEXICON), *induced]))
    size = n_voters + len(PATTERNS)
    part = min(1.0, SAMPLE / max(1, rows.count()))
    chance = F.pmod(F.xxhash64(F.lit("other"), "id"), F.lit(1 << 40)) < int(part * (1 << 40))
    asked = rows.join(F.broadcast(known), "id", "left").select("text", "id", F.col("toxic").alias("given"), (F.col("toxic").isNotNull() | F.coalesce(chance, F.lit(False))).alias("wanted"))

    def run(batches):
        remembered = Known(index)
        for batch in batches:
            fired, shown = [], []
            for x, wanted in zip(batch.column(0), batch.column(3).to_pylist(), strict=True):
                f, p = votes(x.as_py(), index, n_voters, remembered)
                fired.append([i for i in f if i < n_voters] + p)
                shown.append(f if wanted else None)
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(fired, kind), pa.array(shown, kind)], names=["id", "given", "found", "shown"])

    kind = docs.schema[id_col].dataType.simpleString()
    seen = written(asked.mapInArrow(trimmed(run), f"id {kind}, given int, found array<int>, shown array<int>"), "votes")
    found = Votes(seen.select("found", "given"), size)
    rows_of = F.min(F.struct("shown", "given", "found")).alias("r")
    sample = seen.filter("shown is not null").groupBy("id").agg(rows_of).select("id", "r.*").collect()
    sample.sort(key=lambda r: (r.shown, r.found, r.given is None, r.given or 0))
    if not sample:
        remove(known, seen, found.rows)
        return {"weights": {}, "bias": -3.0, "voters": {}}
    model = label_model(found)
    remove(known, seen, found.rows)
    x = np.zeros((len(sample), len(names)), bool)
    odds = np.full(len(sample), model["base"])
    for k, r in enumerate(sample):
        x[k, r.shown] = True
        odds[k] += model["weight"][r.found].sum() + (0 if r.given is None else LABEL_ODDS if r.given else -LABEL_ODDS)
    w, b = linear(x, 1 / (1 + np.exp(-np.clip(odds, -30, 30))))
    voters = [*names[:n_voters], *PATTERNS]
    return {
        "weights": {f: float(v) for f, v in zip(names, w, strict=True) if abs(v) > 1e-6},
        "bias": b,
        "voters": {v: (float(c), float(t), float(s)) for v, c, t, s in zip(voters, *model["rates"], model["share"], strict=True)},
    }


class Scorer:
    """Scores of whole texts by a trained model; remembers which features each word has in it."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self.known = weights, bias, Known(weights)

    def score(self, text: str | None) -> float:
        z = self.bias + sum(self.weights.get(f, 0.0) for f in sorted(features(tokens(text), self.known)))
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def scored(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score, predicted."""
    held = docs.sparkSession.sparkContext.broadcast((model["weights"], model["bias"]))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        scorer = Scorer(*held.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer.score(x.as_py()) for x in batch.column(1)], pa.float64())], names=[id_col, "score"])

    found = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(trimmed(run), f"`{id_col}` {kind}, score double")
    return found.select(F.col(f"`{id_col}`"), held_out(id_col).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, all columns as they are, whose score is below THRESHOLD."""
    model = train(docs, labels, id_col, text_col)
    held, at = docs.sparkSession.sparkContext.broadcast((model["weights"], model["bias"])), docs.columns.index(text_col)

    def run(batches):
        scorer = Scorer(*held.value)
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(x.as_py()) < THRESHOLD for x in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return scored(docs, train(docs, labels, id_col, text_col), id_col, text_col)
