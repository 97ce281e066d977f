"""Sharding by extendible hashing, in DataFrame operations only.

A row's hash is the first 60 bits of the MD5 of its key. A directory is indexed by hash-prefix bits; a bucket whose
rows pass the byte limit splits on one more bit, and only such buckets do, until every one fits. Cells a few bits
finer than the expected depth are summed once; coarser buckets are sums of cells, ``STEP`` bits at a time, so the rows
aren't read again for each bit and a bucket is the sum of a few rows at every depth. The directory is then read from its
root: a cell goes where a coarser one went, else to its own coarsest bucket that fits. Cells that are still too large
are taken apart by further bits, from their own rows alone.

A bucket whose rows share all 60 bits (one row beyond the limit, or a repeated key) can't be split by its hash: it
stays whole with ``fits`` false. A null key hashes as an empty string, null text has 0 bytes, ties and repeated rows
go where their key goes, an empty table has no shards. Columns other than the key and the text aren't looked at,
whatever their names. ``write_shards`` puts a folder for each shard, named after a column that the rows don't have.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import free, written

BITS = 60
#: Bits beyond the expected depth of the first cells, and bits by which cells that are too large go on.
SLACK, MORE = 6, 8
#: Bits by which buckets are summed and the directory is read at a time.
STEP = 4


def _cell(depth: int):
    return F.shiftright("h", BITS - depth)


def _directory(cells: DataFrame, low: int, deep: int, limit_bytes: int) -> DataFrame:
    """``cell`` and its bucket (``depth``, ``prefix``, ``shard_bytes``, ``shard_docs``): the coarsest from depth ``low`` on that fits; nulls where none does.

    cells: cell, bytes, docs at depth ``deep``.
    """
    steps, at, now = [], deep, cells.select(F.col("cell").alias("prefix"), F.col("bytes").alias("shard_bytes"), F.col("docs").alias("shard_docs"))
    while True:
        least = max(low, at - STEP)
        levels = now.select(F.col("prefix").alias("cell"), "shard_bytes", "shard_docs", F.explode(F.sequence(F.lit(least), F.lit(at))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {at} - depth)"))
        buckets = levels.groupBy("depth", "prefix").agg(F.sum("shard_bytes").alias("shard_bytes"), F.sum("shard_docs").alias("shard_docs"))
        buckets = written(buckets, "buckets")
        fit = buckets.filter((F.col("shard_bytes") <= limit_bytes) | ((F.col("depth") == BITS) if deep == BITS else F.lit(False)))
        own = levels.select("cell", "depth", "prefix").join(fit, ["depth", "prefix"], "left").groupBy("cell").agg(F.min(F.when(F.col("shard_bytes").isNotNull(), F.struct("depth", "prefix", "shard_bytes", "shard_docs"))).alias("b"))
        steps.append((at, own))
        if least == low:
            break
        now = buckets.filter(F.col("depth") == least).select("prefix", "shard_bytes", "shard_docs")
        at = least
    above, was = None, 0
    for at, own in reversed(steps):
        if above is not None:
            coarser = above.select(F.col("cell").alias("up"), F.col("b").alias("of"))
            own = own.withColumn("up", F.shiftright("cell", at - was)).join(coarser, "up").select("cell", F.coalesce("of", "b").alias("b"))
        above, was = written(own, "steps"), at
    return above.select("cell", "b.*")


def assign(docs: DataFrame, limit_bytes: int, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: key, ``n_bytes``, ``shard`` (the bucket's prefix bits), ``depth``, ``shard_bytes``, ``shard_docs``, ``fits``."""
    key, text = F.col(f"`{key_col}`"), F.col(f"`{text_col}`")
    h = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")
    rows = written(docs.select(key.alias("key"), h.alias("h"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")), "hashed")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    low, deep = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total / limit_bytes)))) + SLACK)
    done, left = [], rows
    while True:
        cells = written(left.groupBy(_cell(deep).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("docs")), "cells")
        directory = _directory(cells, low, deep, limit_bytes)
        found = left.withColumn("cell", _cell(deep)).join(directory, "cell")
        done.append(found.filter("depth is not null"))
        if deep == BITS or directory.filter("depth is null").isEmpty():
            break
        left = written(found.filter("depth is null").select("key", "h", "n_bytes"), "oversized")
        low, deep = deep + 1, min(BITS, deep + MORE)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    bits = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(conv(prefix, 10, 2), depth, '0')"))
    return out.select(F.col("key").alias(key_col), "n_bytes", bits.alias("shard"), F.col("depth").cast("long").alias("depth"), "shard_bytes", "shard_docs", (F.col("shard_bytes") <= limit_bytes).alias("fits"))


def write_shards(docs: DataFrame, limit_bytes: int, path: str, key_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the rows, all their columns as they are, below ``path``: a folder ``shard=bits`` for each shard, or with underscores before ``shard`` where the rows have such a column."""
    name, key = free(docs, "shard", "key")
    shards = assign(docs, limit_bytes, key_col, text_col).select(F.col(f"`{key_col}`").alias(key), F.concat(F.lit("b"), "shard").alias(name)).distinct()
    docs.join(shards, F.col(f"`{key_col}`").eqNullSafe(F.col(key))).drop(key).repartition(name).write.partitionBy(name).parquet(path)


def oracle_sql(limit_bytes: int) -> str:
    return f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
     l AS (SELECT doc_id, n_bytes, h, depth, h >> ({BITS} - depth)::INT AS prefix FROM d, range({BITS + 1}) r(depth)),
     b AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_docs FROM l GROUP BY ALL),
     f AS (SELECT l.doc_id, l.n_bytes, l.h, min(l.depth) AS depth FROM l JOIN b USING (depth, prefix)
           WHERE b.shard_bytes <= {limit_bytes} OR depth = {BITS} GROUP BY ALL)
SELECT d.doc_id, d.n_bytes, CASE WHEN f.depth = 0 THEN '' ELSE lpad(bin(b.prefix), f.depth::INT, '0') END AS shard,
       f.depth::BIGINT AS depth, b.shard_bytes, b.shard_docs, b.shard_bytes <= {limit_bytes} AS fits
FROM d JOIN f ON d.h = f.h AND d.doc_id IS NOT DISTINCT FROM f.doc_id AND d.n_bytes = f.n_bytes
JOIN b ON b.depth = f.depth AND b.prefix = d.h >> ({BITS} - f.depth)::INT
"""
