"""License scan by diagonal voting.

All rolling word pairs of every text are hashed and joined to their positions in license templates (a fixed table of
a few hundred rows, hence broadcast). A hit votes for its diagonal, the text position less the template position, so
that a notice that stands in one piece gathers its votes on one diagonal. Neighbouring diagonals (up to ``SHIFT``
apart, as words inserted or left out make them) merge into a span, which is verified by its length and by the share
of the template's pairs that it has. Base phrases need every pair on one diagonal, that is their words consecutively.

Null and empty texts have no words and empty labels. Each input row keeps a row of its own, ties and repeated rows
included; an empty table gives an empty result, and columns other than the id and the text are not looked at. A very
long text's hashes leave the worker in pieces of ``PIECE`` words.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Phrases whose words must stand consecutively, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices as their licenses and stewards word them, and the labels that this scan adds.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-notice", "This work is licensed under the GNU General Public License, version"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-license", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("warranty", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED"),
]
#: Greatest step between diagonals that merge; share of a template's pairs that a span needs; its length in templates.
SHIFT, COVERAGE, LENGTH = 2, 0.7, 1.5
PIECE = 100_000
MARK = 0
_KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Runs of digits, letters lower-cased from A-Z, and bytes of characters beyond ASCII."""
    return text.translate(_KEPT).split()


def pairs(found: list[bytes]) -> list[int]:
    """A signed 64-bit hash of each two neighbouring words."""
    joined = b" ".join(found)
    starts = [0, *accumulate(len(w) + 1 for w in found)]
    f = xxhash.xxh64_intdigest
    return [f(joined[s : e - 1], 7) for s, e in zip(starts, starts[2:], strict=False)]


def _signed(hashes: list[int]) -> np.ndarray:
    return np.array(hashes, np.uint64).view(np.int64)


def template_rows(templates=TEMPLATES, base=BASE) -> list[tuple]:
    """hash, template, position, pairs of the template, its label, whether it is a base phrase."""
    out = [(MARK, -1, 0, 1, None, False)]
    for k, (label, text, is_base) in enumerate([*((v, t, True) for t, v in base.items()), *((a, b, False) for a, b in templates)]):
        hashes = _signed(pairs(words(text.encode()))).tolist()
        out += [(h, k, i, len(hashes), label, is_base) for i, h in enumerate(hashes)]
    return out


def hashed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of each row's pair hashes: row, id, n_words, word at which the piece starts, hashes. The first piece starts with MARK at -1."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        part, n = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            ids, rows, counts, at, found, size = [], [], [], [], [], 0
            for i, x in enumerate(batch.column(1).cast(pa.binary())):
                w = words(x.as_py() or b"")
                h = _signed([MARK, *pairs(w)])
                for a in range(0, len(h), PIECE):
                    ids.append(i)
                    rows.append(part + n)
                    counts.append(len(w))
                    at.append(a - 1)
                    found.append(h[a : a + PIECE])
                    size += len(found[-1])
                n += 1
                if size > 500_000:
                    yield piece(batch, ids, rows, counts, at, found)
                    ids, rows, counts, at, found, size = [], [], [], [], [], 0
            if ids:
                yield piece(batch, ids, rows, counts, at, found)

    def piece(batch, ids, rows, counts, at, found):
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        hashes = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), batch.column(0).take(pa.array(ids)), pa.array(counts, pa.int64()), pa.array(at, pa.int64()), hashes], names=["row", "id", "n_words", "at", "hashes"])

    return docs.select(id_col, text_col).mapInArrow(run, f"row long, id {kind}, n_words long, at long, hashes array<long>")


def spans(spark: SparkSession, docs: DataFrame, templates=TEMPLATES, base=BASE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of every row: row, id, n_words, label, is_base, start and end word, coverage, verified. A row has also one span with template -1."""
    table = spark.createDataFrame(template_rows(templates, base), "h long, template int, place int, pairs int, label string, is_base boolean")
    grams = hashed(docs, id_col, text_col).select("row", "id", "n_words", "at", F.posexplode("hashes").alias("k", "h")).select("row", "id", "n_words", (F.col("at") + F.col("k")).alias("pos"), "h")
    hits = grams.join(F.broadcast(table), "h").filter("(template = -1) = (pos = -1)")
    whole = ["row", "id", "n_words", "template", "pairs", "label", "is_base"]
    votes = hits.groupBy(*whole, (F.col("pos") - F.col("place")).alias("diagonal")).agg(F.count("*").alias("votes"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("is_base") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > SHIFT, F.lit(True))
    merged = votes.withColumn("span", F.sum(apart.cast("int")).over(order)).groupBy(*whole, "span").agg(F.sum("votes").alias("votes"), F.min("low").alias("start"), (F.max("high") + 2).alias("end"))
    coverage = F.least(F.lit(1.0), F.col("votes") / F.col("pairs"))
    fits = F.when(F.col("is_base"), F.col("votes") == F.col("pairs")).otherwise((coverage >= COVERAGE) & (F.col("end") - F.col("start") <= (F.col("pairs") + 1) * LENGTH))
    return merged.select("row", "id", "n_words", "template", "label", "is_base", "start", "end", coverage.alias("coverage"), fits.alias("verified"))


def scan(spark: SparkSession, docs: DataFrame, templates=TEMPLATES, base=BASE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score (1 for a base phrase, else the best span's coverage, half of it where that isn't verified)."""
    found = spans(spark, docs, templates, base, id_col, text_col)
    good = F.col("verified") & (F.col("template") >= 0)
    of_base = good & F.col("is_base")
    joined = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    score = F.when(F.col("template") < 0, 0.0).when(F.col("verified"), F.col("coverage")).otherwise(F.col("coverage") / 2)
    return (
        found.groupBy("row", "id", "n_words")
        .agg(F.count_if(of_base).alias("n_base"), F.min(F.when(of_base, F.col("start"))).alias("first_word"), F.max(F.when(of_base, F.col("start"))).alias("last_word"), joined(of_base).alias("base_labels"), joined(good).alias("labels"), F.max(score).alias("score"))
        .drop("row")
        .withColumnRenamed("id", id_col)
    )
