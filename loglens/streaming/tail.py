"""Following growing logs with Structured Streaming.

A writer rolls segments: every flush makes a new file that ends at a line end, named so that names sort in order. Each
micro-batch takes new segments; a line's number is its place in its segment plus the lines of the source's earlier
segments, which a state table of segment sizes carries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loglens.operators.scan import ready
from loglens.plans.filters import FilterSet
from loglens.plans.query import Options, compiled
from loglens.sources.lines import read

TRIGGER = "500 milliseconds"


def segments(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Lines of new segment files below a folder, with the file that each comes from."""
    found = spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", max_files).text(folder)
    return found.select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"\r\z", "").alias("line"))


def matching(stream: DataFrame, source: str, options: Options = Options()) -> DataFrame:  # noqa: B008
    """Lines of the stream that a query matches."""
    query = compiled(source, options)
    return stream if query.empty else ready(stream, query).filter(query.column)


def running_counts(stream: DataFrame, filters: FilterSet) -> DataFrame:
    """Lines so far, and hits of each filter; a stateful count that starts anew with its checkpoint."""
    return stream.groupBy(F.lit(0).alias("all")).agg(F.count("*").alias("lines"), *filters.counts()).drop("all")


def follow(stream: DataFrame, name: str, mode: str = "append", path: str | None = None, checkpoint: str | None = None, trigger: str | None = None) -> StreamingQuery:
    """Starts a query: into Parquet files at ``path``, or a table in memory."""
    out = stream.writeStream.outputMode(mode).queryName(name)
    out = out.trigger(processingTime=trigger) if trigger else out
    out = out.option("checkpointLocation", checkpoint) if checkpoint else out
    return out.format("parquet").start(path) if path else out.format("memory").start()


def numbered(spark: SparkSession, folder: str) -> DataFrame:
    """All segments so far as numbered lines, for views beside the stream; a source is its folder."""
    lines = read(spark, folder)
    sizes = lines.groupBy("source_id").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("source_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("source_id", before.alias("before"))
    return lines.join(offsets, "source_id").select(F.lit(0).cast("long").alias("source_id"), (F.col("before") + F.col("line_no")).alias("line_no"), "line")


def stopped(query: StreamingQuery) -> None:
    """Stops a query after what has arrived is dealt with."""
    query.processAllAvailable()
    query.stop()
