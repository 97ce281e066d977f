"""Log-shaped frames from the driver's tables: source_id, line_no, line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str, year: bool = True, sources: int = 1) -> DataFrame:
    """A record for each event, dealt to ``sources`` files by its id."""
    e = table(spark, sf_dir, "events")
    letter = F.when(F.col("event_type") == "error", "E").when(F.col("event_type") == "purchase", "W").when(F.col("event_type") == "signup", "I").when(F.col("event_type") == "click", "D").otherwise("V")
    stamp = F.date_format("ts", ("yyyy-" if year else "") + "MM-dd HH:mm:ss.SSSSSS")
    msg = F.concat(F.lit("value="), F.col("value").cast("decimal(18,2)").cast("string"), F.lit(" props="), "props")
    line = F.concat(stamp, F.lit("  "), F.col("user_id").cast("string"), F.lit("  "), (F.col("event_id") % 1000).cast("string"), F.lit(" "), letter, F.lit(" "), "event_type", F.lit(": "), msg)
    return e.select((F.col("event_id") % sources).alias("source_id"), F.expr(f"event_id div {sources}").alias("line_no"), line.alias("line"))


def exploded(df: DataFrame, key: str, text: str) -> DataFrame:
    """Lines of texts: cut at line feeds, one carriage return taken off, no line after a final line feed."""
    whole = F.regexp_replace(F.col(text), r"\n\z", "")
    lines = df.filter(F.coalesce(F.col(text) != "", F.lit(False))).select(F.col(key).alias("source_id"), F.posexplode(F.split(whole, "\n", -1)).alias("line_no", "line"))
    return lines.select("source_id", F.col("line_no").cast("long").alias("line_no"), F.regexp_replace("line", r"\r\z", "").alias("line"))


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(table(spark, sf_dir, "documents"), "doc_id", "text")


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(table(spark, sf_dir, "pages"), "page_id", "html")


def chat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source_id"), F.col("turn").alias("line_no"), F.col("text").alias("line"))


def event_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.lit(0).cast("long").alias("source_id"), F.col("event_id").alias("line_no"), F.col("props").alias("line"))
