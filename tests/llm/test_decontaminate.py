import random

from loglens.llm import decontaminate, queries
from loglens.llm.common import table


def least_distance(pattern, text):
    """Edit distance between the pattern and its nearest substring of the text, by the plain recurrence."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_myers():
    r = random.Random(1)
    for _ in range(200):
        p, t = ("".join(r.choices("abc", k=r.randint(1, n))) for n in (12, 40))
        assert min(decontaminate.myers(p, t)) in (least_distance(p, t), len(p)) and min(len(p), *decontaminate.myers(p, t)) == least_distance(p, t)


def test_edits_and_edges(spark, monkeypatch):
    r = random.Random(2)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(r.choice([12, 40, 120])))) for i in range(6)] + [(90, None), (91, ""), (92, "too short"), (93, "x" * 23), (94, "!?"), (None, " ".join(word() for _ in range(20)))]
    docs = [(0, None), (1, ""), (None, items[0][1])]
    for k in range(40):
        text = list(items[k % 6][1])
        for _ in range(r.randint(0, len(text) // 12)):
            text[r.randrange(len(text))] = r.choice("xyz ")
        docs.append((10 + k, " ".join(word() for _ in range(30)) + "! " + "".join(text).title() + ", " + " ".join(word() for _ in range(30))))
    docs += [docs[5], (200, items[9][1].upper()), (201, " ".join(word() for _ in range(4000))), (202, "it is Too short!"), (203, "x" * 23), (204, "it is too shorter")]
    want = set()
    for d, t in docs:
        for i, x in items:
            p = decontaminate.plain(x)
            if p and least_distance(f" {p} ", f" {decontaminate.plain(t)} ") <= int(len(p) * decontaminate.RATE):
                want.add((d, i))
    assert {(202, 92), (203, 93)} <= want and (204, 92) not in want
    for block in (8 << 20, 500):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        got = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
        assert {(x.doc_id, x.item_id) for x in got} == want
    cleaned = decontaminate.clean(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string"))
    assert cleaned.columns == ["doc_id", "text", "item_id"] and cleaned.count() == sum(d not in {x for x, _ in want} for d, _ in docs)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert decontaminate.matches(none, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_query_finds_all_whole_copies(spark, sf):
    docs, items = table(spark, sf, "documents").collect(), table(spark, sf, "benchmark").collect()
    got = {(r.doc_id, r.item_id): r.distance for r in queries.op3_decontaminate(spark, sf).collect()}
    for d in docs:
        text = decontaminate.plain(d.text)
        for i in items:
            if decontaminate.plain(i.text) in text:
                assert got[d.doc_id, i.item_id] == 0


def test_one_rule_across_lengths():
    """Items of 500 and of 520 bytes are held alike: as a whole, within their edits; half of one is not held."""
    r = random.Random(9)
    for size in (20, 23, 24, 100, 500, 512, 513, 520, 1500):
        item = "".join(r.choices("abcdefgh", k=size))
        s = decontaminate.Searcher([(1, item)])
        edited = list(item)
        for at in range(0, size, max(1, size // max(1, int(size * 0.06)))):
            edited[at] = "x"
        allowed = sum(a != b for a, b in zip(edited, item, strict=True)) <= int(size * 0.06)
        assert bool(list(s.search("before " + "".join(edited) + " after"))) == allowed
        assert list(s.search(f"before {item} after")) and not list(s.search("before " + item[: size // 2] + " after")) and not list(s.search(""))


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([(1, "one short item")], "doc_id long, text string")
    for kind, value in (("date", __import__("datetime").date(2024, 1, 1)), ("double", 2.5), ("string", "k")):
        got = decontaminate.matches(docs, spark.createDataFrame([(value, "short item")], f"item_id {kind}, text string")).collect()
        assert [(r.item_id, r.distance) for r in got] == [(value, 0)]
