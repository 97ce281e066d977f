"""A synthetic log for benchmarks and tests: one line in twelve is a hit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAGS = ["Camera", "Network", "Render", "Audio", "Storage", "Sensor"]
HITS = ["session opened", "session closed", "frame dropped", "retry scheduled", "cache missed", "buffer full", "link lost", "link up", "focus locked", "upload done", "config changed", "low memory"]


def generated(spark: SparkSession, lines: int) -> DataFrame:
    n = F.col("id")
    stamp = F.date_format(F.timestamp_micros((F.lit(1_704_067_200_000_000) + n * 6993).cast("long")), "MM-dd HH:mm:ss.SSS")
    hit = n % 12 == 0
    pick = lambda words, at: F.element_at(F.array(*map(F.lit, words)), (at + 1).cast("int"))
    msg = F.when(hit, pick(HITS, F.expr("id div 12") % 12)).otherwise(F.concat(F.lit("frame="), n.cast("string"), F.lit(" status=ok latency="), (n % 31).cast("string")))
    line = F.concat_ws(" ", stamp, (F.lit(1000) + n % 40).cast("string"), (F.lit(2000) + n % 97).cast("string"), F.when(hit, "I").otherwise("D"), F.concat(pick(TAGS, n % 6), F.lit(":")), msg)
    return spark.range(lines).select(F.lit(0).cast("long").alias("source_id"), n.alias("line_no"), line.alias("line"))
