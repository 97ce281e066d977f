"""Scans of lines by query and filter set. Frames have source_id, line_no and line."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.functions.records import DAY_NS, with_record
from loglens.plans.filters import FilterSet
from loglens.plans.query import Options, Query, compiled

#: Results beyond these many rows are worth a warning.
MANY_MATCHES, MANY_MERGED = 200_000_000, 100_000_000
BASE_LINES = 64


@dataclass
class Outcome:
    """The lines that are left, and whether anything was asked of them at all."""

    lines: DataFrame
    restricted: bool


def ready(lines: DataFrame, query: Query) -> DataFrame:
    """The lines, with record fields where the query needs them and they aren't there."""
    return with_record(lines) if query.needs_fields and "structured" not in lines.columns else lines


def by_query(lines: DataFrame, source: str, options: Options = Options()) -> Outcome:  # noqa: B008
    query = compiled(source, options)
    return Outcome(lines if query.empty else ready(lines, query).filter(query.column), not query.empty)


def by_filters(lines: DataFrame, filters: FilterSet) -> Outcome:
    if not filters.restricts:
        return Outcome(lines, False)
    seen, found = filters.ready(lines)
    return Outcome(seen.filter(found.visible()).drop("_low"), True)


def by_both(lines: DataFrame, filters: FilterSet, source: str, options: Options = Options()) -> Outcome:  # noqa: B008
    query = compiled(source, options)
    seen, found = filters.ready(ready(lines, query))
    return Outcome(seen.filter(query.column & found.visible()).drop("_low"), filters.restricts or not query.empty)


def temporary(lines: DataFrame, filters: FilterSet, source: str, options: Options = Options()) -> Outcome:  # noqa: B008
    """A query typed for the moment over configured filters."""
    query = compiled(source, options)
    seen, found = filters.ready(ready(lines, query))
    return Outcome(seen.filter(found.visible_with(query.column)).drop("_low"), True)


def counts(lines: DataFrame, filters: FilterSet) -> DataFrame:
    """Lines that each filter hits: filter, n. One pass, whatever the number of filters."""
    if not filters.filters:
        return lines.sparkSession.createDataFrame([], "filter long, n long")
    pairs = [F.struct(F.lit(i).cast("long").alias("filter"), F.col(f"n_{i}").alias("n")) for i in range(len(filters.filters))]
    seen, found = filters.ready(lines)
    return seen.agg(*found.counts()).select(F.inline(F.array(*pairs)))


def summary(matches: DataFrame) -> DataFrame:
    """Matches, and the sources that have any."""
    return matches.agg(F.count("*").alias("matches"), F.count_distinct("source_id").alias("sources"))


def size_warning(matches: int, merged: int = 0) -> str | None:
    """What to say of a result before it is shown or kept, if it is very large."""
    if matches > MANY_MATCHES:
        return f"{matches:,} matches are more than {MANY_MATCHES:,}"
    return f"{merged:,} merged rows are more than {MANY_MERGED:,}" if merged > MANY_MERGED else None


def inferred_base(lines: DataFrame) -> int | None:
    """The first timestamp of the first lines, for times without a date."""
    first = lines.filter(F.col("line_no") < BASE_LINES)
    first = first if "ts_ns" in first.columns else with_record(first)
    row = first.filter("ts_ns is not null").orderBy("line_no").select("ts_ns").first()
    return None if row is None else row[0]


def base_day(ns: int) -> int:
    return ns // DAY_NS * DAY_NS
