"""A training-corpus pipeline over ``documents``; counted as part of loglens.llm.

Every stage takes what its predecessor kept, as a Parquet table, and all but the last return the columns of
``documents``: toxic documents go; of near-duplicate documents (five-word shingles, Jaccard similarity 0.8) one stays;
passages of ``PASSAGE`` bytes or ``WORDS`` words or more that occur twice are cut out of the texts; documents that hold a benchmark item
go; the rest is encoded and decoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.llm import decontaminate, repeats, sentencepiece_bpe, simhash, toxicity
from loglens.llm.common import table, written

#: Bytes of a repeated passage, about 45 words; 51 words are sometimes fewer bytes, so they count as well.
PASSAGE, WORDS = 250, 51


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that score as toxic go."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: one document of each group of near duplicates stays."""
    return simhash.one_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: repeated passages go; ``n_chars`` follows the text."""
    return repeats.kept_texts(docs, PASSAGE, words=WORDS).withColumn("n_chars", F.char_length("text").cast("long"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: token counts and digests of ids and decoded texts."""
    return sentencepiece_bpe.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("toxicity", toxic), ("near_duplicates", near), ("repeated_passages", passages), ("decontamination", benchmark), ("sentencepiece", tokens)]
#: SQL can't express the label model, the sketches or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
