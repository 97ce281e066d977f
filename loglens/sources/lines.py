"""Text files as numbered lines, and the same kept as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglens.functions.text import fnv1a64
from loglens.sources.encodings import HEAD, decoded, detected, named


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def head(spark: SparkSession, path: str, size: int = HEAD) -> bytes:
    """A file's first bytes, from any file system that Spark reads."""
    p, fs = _file_system(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(size, fs.getFileStatus(p).getLen())))
    finally:
        stream.close()


def size(spark: SparkSession, path: str) -> int:
    """A file's length in bytes."""
    p, fs = _file_system(spark, path)
    return fs.getFileStatus(p).getLen()


def numbered(df: DataFrame) -> DataFrame:
    """line_no for rows with file, block and at, which rises by one from line to line of a block.

    Blocks are counted, and a row's number is its place in its block plus the sizes of the blocks before; only the
    table of blocks is ordered, and lines move for the join with it alone where that table can't be broadcast.
    """
    sizes = df.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("least"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("file", "block", (before - F.col("least")).alias("offset"))
    return df.join(offsets, ["file", "block"]).withColumn("line_no", F.col("at") + F.col("offset")).drop("offset", "block", "at")


def read(spark: SparkSession, paths: str | list[str], encoding: str | None = None) -> DataFrame:
    """Lines of files: source_id (by path), file, line_no from 0, raw (bytes without the line's end) and line.

    Lines end at a line feed, one carriage return before it is no part of them, and a final line feed starts no line.
    A file's charset is the one named, or told from its first 64 KiB. The byte order mark stays in line 0.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    text = spark.read.option("lineSep", "\n").text(paths)
    rows = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("bytes"))
    cut = F.when(F.expr("endswith(bytes, X'0D')"), F.expr("substring(bytes, 1, octet_length(bytes) - 1)")).otherwise(F.col("bytes"))
    found = numbered(rows).select("file", "line_no", cut.alias("raw"))
    files = sorted(r[0] for r in text.select("_metadata.file_path").distinct().collect())
    labels = {f: named(encoding) if encoding else detected(head(spark, f))[0] for f in files}
    source, line = F.lit(None).cast("long"), F.lit(None).cast("string")
    for i, f in enumerate(files):
        source = F.when(F.col("file") == f, i).otherwise(source)
    for label in sorted(set(labels.values())):
        line = F.when(F.col("file").isin([f for f in files if labels[f] == label]), decoded(F.col("raw"), label)).otherwise(line)
    return found.select(source.cast("long").alias("source_id"), "file", "line_no", "raw", line.alias("line"))


def span(lines: DataFrame, first: int, count: int) -> DataFrame:
    """``count`` lines from ``first`` on; a range that Parquet kept by kept() prunes by."""
    return lines.filter((F.col("line_no") >= first) & (F.col("line_no") < first + count))


def suffix(lines: DataFrame, first: int) -> DataFrame:
    return lines.filter(F.col("line_no") >= first)


def cache_key(spark: SparkSession, path: str) -> str:
    """A name that changes with a file's path, length or time."""
    p, fs = _file_system(spark, path)
    status = fs.getFileStatus(p)
    return f"{fnv1a64(str(status.getPath()).encode()):016x}-{status.getLen()}-{status.getModificationTime()}"


def kept(spark: SparkSession, path: str, cache_dir: str, encoding: str | None = None) -> DataFrame:
    """read() by way of a Parquet table ordered by line, written once for a file's path, length and time."""
    at = f"{cache_dir.rstrip('/')}/{cache_key(spark, path)}-{named(encoding) if encoding else 'auto'}"
    p, fs = _file_system(spark, f"{at}/_SUCCESS")
    if not fs.exists(p):
        read(spark, path, encoding).repartitionByRange("source_id", "line_no").sortWithinPartitions("source_id", "line_no").write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def piece(spark: SparkSession, path: str, start: int, count: int) -> bytes:
    """``count`` bytes of a file from ``start`` on, or as many as there are."""
    p, fs = _file_system(spark, path)
    stream = fs.open(p)
    try:
        stream.seek(start)
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, max(0, min(count, fs.getFileStatus(p).getLen() - start))))
    finally:
        stream.close()


def ends(spark: SparkSession, path: str) -> tuple[bytes, bytes, int]:
    """A file's first and last bytes and its length, by which grown() knows it again."""
    n = size(spark, path)
    return head(spark, path), piece(spark, path, max(0, n - HEAD), HEAD), n


def grown(spark: SparkSession, path: str, earlier_head: bytes, earlier_length: int, earlier_tail: bytes = b"") -> bool:
    """Whether a file has only been added to: as long as before at least, and with the same bytes where it started and where it ended."""
    if size(spark, path) < earlier_length or head(spark, path, len(earlier_head)) != earlier_head:
        return False
    return piece(spark, path, earlier_length - len(earlier_tail), len(earlier_tail)) == earlier_tail


def kind_of(path: str) -> str:
    """What a path holds: a filter configuration (tat, or native JSON) or a log."""
    end = path.lower().rpartition(".")[2]
    return "tat" if end == "tat" else "filters" if end in ("lens", "filters") else "log"
