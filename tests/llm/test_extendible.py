import hashlib
from collections import defaultdict

import pytest

from loglens.llm import extendible, queries
from loglens.llm.common import new_path, table


def brute(rows, limit):
    """A directory that doubles: buckets beyond the limit split on their next bit."""
    bits = lambda k: f"{int(hashlib.md5(('' if k is None else str(k)).encode()).hexdigest()[:15], 16):060b}"
    data = [(k, len((t or "").encode()), bits(k)) for k, t in rows]
    out, todo = [], [("", data)]
    while todo:
        prefix, held = todo.pop()
        size = sum(n for _, n, _ in held)
        if size <= limit or len(prefix) == 60:
            out += [(k, n, prefix, len(prefix), size, len(held), size <= limit) for k, n, _ in held]
            continue
        parts = defaultdict(list)
        for r in held:
            parts[prefix + r[2][len(prefix)]].append(r)
        todo += list(parts.items())
    return out


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


def check(df, rows, limit):
    assert sorted(map(tuple, df.collect()), key=key) == sorted(brute(rows, limit), key=key)


@pytest.mark.parametrize("limit", [1, 30, 200, 10**6])
def test_against_a_doubling_directory(spark, limit):
    rows = [(i, "x" * (i % 17)) for i in range(150)] + [(None, "null id"), (500, None), (501, ""), (502, "y" * 300), (7, "twin"), (7, "twin"), (7, "other")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int")
    check(extendible.assign(df, limit), rows, limit)


def test_empty_table_and_files(spark):
    assert extendible.assign(spark.createDataFrame([], "doc_id long, text string"), 10).count() == 0
    df = spark.createDataFrame([(i, "z" * 10) for i in range(40)] + [(None, "n")], "doc_id long, text string")
    path = new_path(spark, "shards")
    extendible.write_shards(df, 50, path)
    back = spark.read.parquet(path)
    assert back.count() == 41 and max(r["count"] for r in back.groupBy("shard").count().collect()) <= 5


def test_shards_keep_columns_of_their_names(spark):
    df = spark.createDataFrame([(i, "z" * 10, i, "k") for i in range(20)], "doc_id long, text string, shard int, `key` string")
    path = new_path(spark, "shards")
    extendible.write_shards(df, 50, path)
    back = spark.read.parquet(path)
    assert sorted((r.doc_id, r.shard, r.key) for r in back.collect()) == [(i, i, "k") for i in range(20)] and "_shard" in back.columns


def test_query(spark, sf):
    check(queries.op7_extendible(spark, sf), [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()], queries.SHARD_BYTES)
