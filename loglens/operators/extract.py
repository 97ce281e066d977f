"""Tables from lines: groups of a regular expression, or keys of JSON objects. All cells are strings."""

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.functions.regexes import PatternError, translated
from loglens.functions.text import line_range

KEY = ["source_id", "line_no"]


@dataclass
class Table:
    """Records with their line, the names of their columns, and what was wrong with the pattern."""

    records: DataFrame | None
    columns: list[str]
    error: str | None = None


def ranged(lines: DataFrame, text: str | None) -> DataFrame:
    """Lines of a typed range; the whole where it is none."""
    found = line_range(text) if text else None
    return lines if found is None else lines.filter((F.col("line_no") >= found[0]) & (F.col("line_no") < found[1]))


def by_regex(lines: DataFrame, pattern: str, lines_range: str | None = None, max_rows: int | None = None) -> Table:
    """A row for each line that matches, its first match alone; groups without a name are group_1 and so on, and without groups the match is the cell."""
    try:
        found, names = translated(pattern, ignore_case=False)
    except PatternError as e:
        return Table(None, [], str(e))
    columns = [n or f"group_{i}" for i, n in enumerate(names, 1)] or ["match"]
    cells = [F.regexp_extract("line", found, i if names else 0).alias(c) for i, c in enumerate(columns, 1)]
    rows = ranged(lines, lines_range).filter(F.col("line").rlike(found)).select(*KEY, *cells)
    return Table(rows if max_rows is None else rows.orderBy(*KEY).limit(max_rows), columns)


def cell(value) -> str:
    if value is None:
        return ""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def json_maps(lines: DataFrame) -> DataFrame:
    """Lines that are JSON objects as maps of strings: null is empty, nested values are compact JSON with sorted keys."""

    @F.pandas_udf("map<string,string>")
    def fields(found: pd.Series) -> pd.Series:
        def one(text):
            try:
                x = json.loads(text)
            except (TypeError, ValueError, RecursionError):
                return None
            return {k: cell(v) for k, v in x.items()} if isinstance(x, dict) else None

        return found.map(one)

    return lines.select(*KEY, fields("line").alias("m")).filter("m is not null")


def by_json(lines: DataFrame, max_rows: int | None = None) -> Table:
    """A row for each JSON object, and a column for every key of any of them, sorted."""
    maps = json_maps(lines)
    keys = sorted(r[0] for r in maps.select(F.explode(F.map_keys("m"))).distinct().collect())
    rows = maps.select(*KEY, *[F.coalesce(F.col("m")[k], F.lit("")).alias(k) for k in keys])
    return Table(rows if max_rows is None else rows.orderBy(*KEY).limit(max_rows), keys)


def document_lines(spark, text: str) -> DataFrame:
    """Objects of one JSON document (an array's objects, or the object itself), else its lines."""
    try:
        whole = json.loads(text)
    except ValueError:
        whole = None
    found = [json.dumps(x) for x in whole if isinstance(x, dict)] if isinstance(whole, list) else [json.dumps(whole)] if isinstance(whole, dict) else text.splitlines()
    return spark.createDataFrame([(0, i, x) for i, x in enumerate(found)], "source_id long, line_no long, line string")


def extracted(lines: DataFrame, pattern: str, head: str = "", lines_range: str | None = None, max_rows: int | None = None) -> Table:
    """By pattern if there is one, else by JSON keys if the text starts as JSON does, else nothing."""
    if pattern:
        return by_regex(lines, pattern, lines_range, max_rows)
    return by_json(lines, max_rows) if head.lstrip()[:1] in ("{", "[") else Table(None, [])


def metrics(lines: DataFrame, table: Table) -> tuple[int, int]:
    """Lines looked at, and rows."""
    return lines.count(), 0 if table.records is None else table.records.count()
