"""Writers: JSON rows, filtered and edited copies, CSV."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.operators.render import truncated
from loglens.operators.views import edited

MAX_LINES, MAX_BYTES = 100, 4096


def json_rows(lines: DataFrame, max_lines: int | None = MAX_LINES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``json``: line (from 1), text, truncated; the first lines in order."""
    some = lines.orderBy("source_id", "line_no").limit(max_lines) if max_lines is not None else lines
    cut = truncated(F.col("line"), max_bytes)
    record = F.struct((F.col("line_no") + 1).alias("line"), cut["text"].alias("text"), cut["truncated"].alias("truncated"))
    return some.select("source_id", "line_no", F.to_json(record, {"ignoreNullFields": "false"}).alias("json"))


def csv_field(value: Column) -> Column:
    """Quoted only if it holds a comma, a quote, CR or LF."""
    return F.when(value.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def csv_rows(records: DataFrame, headers: dict[str, str] | None = None) -> tuple[str, DataFrame]:
    """The header line, and ``csv`` rows; headers: other names of columns."""
    columns = [c for c in records.columns if c not in ("source_id", "line_no")]
    names = [(headers or {}).get(c, c) for c in columns]
    quoted = ['"' + n.replace('"', '""') + '"' if any(x in n for x in ',"\r\n') else n for n in names]
    row = F.concat_ws(",", *[csv_field(F.coalesce(F.col(c), F.lit(""))) for c in columns])
    return ",".join(quoted), records.select("source_id", "line_no", row.alias("csv"))


def refuse_own(path: str, sources: list[str]) -> None:
    """Raises if a file would be written over one that it is made from."""
    plain = lambda p: os.path.normpath(p.removeprefix("file://"))
    if plain(path) in {plain(s) for s in sources}:
        raise ValueError("a source can't be its own export")


def write_lines(lines: DataFrame, path: str, sources: list[str] = (), end: str = "\n") -> None:
    """Lines in order below ``path``, a text file for each range of them, their names in order too."""
    refuse_own(path, list(sources))
    ordered = lines.repartitionByRange("source_id", "line_no").sortWithinPartitions("source_id", "line_no")
    ordered.select("line").write.option("lineSep", end).text(path)


def write_edited(lines: DataFrame, edits: DataFrame, path: str, sources: list[str] = (), end: str = "\n") -> None:
    """A copy of all lines with edits (source_id, line_no, edit) in their place."""
    write_lines(edited(lines, edits), path, sources, end)


def joined(lines: DataFrame) -> DataFrame:
    """``text``: the chosen lines of each source as one text, in order; for a selection that is copied."""
    order = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy("source_id").agg(F.array_join(F.transform(order, lambda x: x["line"]), "\n").alias("text"))
