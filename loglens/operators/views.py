"""Views over lines: context, navigation, ranks, display sets, pins, marks, edits and the merge by time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["source_id", "line_no"]


def _order(*extra: str):
    return Window.partitionBy("source_id").orderBy("line_no", *extra)


def segments(matches: DataFrame, totals: DataFrame, context: int) -> DataFrame:
    """Half-open runs of lines within ``context`` of a match: source_id, start, end, gap_before. Runs that touch are one; totals: source_id, total."""
    near = matches.join(totals, "source_id").filter("line_no < total")
    spans = near.select("source_id", F.greatest(F.lit(0).cast("long"), F.col("line_no") - context).alias("start"), F.least(F.col("total"), F.col("line_no") + context + 1).alias("end"))
    order = Window.partitionBy("source_id").orderBy("start", "end")
    apart = F.coalesce(F.col("start") > F.lag("end").over(order), F.lit(True))
    runs = spans.withColumn("run", F.sum(apart.cast("int")).over(order)).groupBy("source_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.select("source_id", "start", "end", (F.col("start") - F.lag("end", 1, 0).over(Window.partitionBy("source_id").orderBy("start"))).alias("gap_before"))


def context_lines(lines: DataFrame, found: DataFrame) -> DataFrame:
    """The lines of segments, with their row in the view and whether a segment starts there."""
    at = found.select("source_id", F.explode(F.sequence("start", F.col("end") - 1)).alias("line_no"), "start")
    rows = lines.join(at, KEY)
    return rows.withColumn("row", (F.row_number().over(_order()) - 1).cast("long")).withColumn("starts_segment", F.col("line_no") == F.col("start")).drop("start")


def ranked(matches: DataFrame) -> DataFrame:
    """Matches with their ordinal in the source, and the ones before and after."""
    w = _order()
    return matches.withColumns({"ordinal": (F.row_number().over(w) - 1).cast("long"), "previous": F.lag("line_no").over(w), "next": F.lead("line_no").over(w)})


def after(matches: DataFrame, line_no: int) -> DataFrame:
    """The first match behind a line, by source."""
    return matches.filter(F.col("line_no") > line_no).groupBy("source_id").agg(F.min("line_no").alias("line_no"))


def before(matches: DataFrame, line_no: int) -> DataFrame:
    return matches.filter(F.col("line_no") < line_no).groupBy("source_id").agg(F.max("line_no").alias("line_no"))


def nth(matches: DataFrame, n: int) -> DataFrame:
    return ranked(matches).filter(F.col("ordinal") == n).select(*KEY)


def count_in(matches: DataFrame, first: int, end: int) -> DataFrame:
    """Matches of a half-open range of lines, by source."""
    return matches.groupBy("source_id").agg(F.count_if((F.col("line_no") >= first) & (F.col("line_no") < end)).alias("n"))


def line_to_row(view: DataFrame, line_no: int) -> DataFrame:
    """The row at which a line stands, or the next one that is shown."""
    return view.groupBy("source_id").agg(F.count_if(F.col("line_no") < line_no).alias("row"))


def row_to_line(view: DataFrame, row: int) -> DataFrame:
    return nth(view, row)


def around(matches: DataFrame, source: int, line_no: int, forward: bool = True) -> DataFrame:
    """The next match behind (or before) a place over all sources in order, from the other end if there is none."""
    here = F.struct(F.lit(source).cast("long").alias("source_id"), F.lit(line_no).cast("long").alias("line_no"))
    key = F.struct(F.col("source_id").cast("long").alias("source_id"), F.col("line_no").cast("long").alias("line_no"))
    beyond = key > here if forward else key < here
    order = [F.desc(beyond), *([F.asc(c) if forward else F.desc(c) for c in KEY])]
    return matches.orderBy(*order).limit(1).select(*KEY)


def display(lines: DataFrame, visible: Column | None, found: Column | None) -> DataFrame:
    """What is shown: lines that filters leave, that a search finds, both together, or all."""
    shown = [c for c in (visible, found) if c is not None]
    return lines.filter(reduce(lambda a, b: a | b, shown)) if shown else lines


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Lines of either set of matches, once each."""
    return a.select(*KEY).union(b.select(*KEY)).distinct()


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(*KEY).distinct(), KEY, "left_anti")


def pinned(view: DataFrame, lines: DataFrame, source: int, line_no: int) -> DataFrame:
    """The view with a line that stays in it."""
    pin = lines.filter((F.col("source_id") == source) & (F.col("line_no") == line_no))
    return view.unionByName(pin.join(view.select(*KEY), KEY, "left_anti").select(*view.columns))


def edited(lines: DataFrame, edits: DataFrame) -> DataFrame:
    """Lines with edits (source_id, line_no, edit) put in their place."""
    return lines.join(edits, KEY, "left").withColumn("line", F.coalesce("edit", "line")).drop("edit")


def marked(lines: DataFrame, marks: DataFrame) -> DataFrame:
    return lines.join(marks.select(*KEY).distinct(), KEY, "left_semi")


def toggled(marks: DataFrame, picks: DataFrame) -> DataFrame:
    """Marks with those of the picks set that weren't and taken back that were."""
    both = marks.select(*KEY).distinct().withColumn("a", F.lit(1)).unionByName(picks.select(*KEY).distinct().withColumn("a", F.lit(1)))
    return both.groupBy(*KEY).agg(F.sum("a").alias("n")).filter("n = 1").drop("n")


def refreshed(previous: DataFrame, tail: DataFrame, first: int) -> DataFrame:
    """Matches of a file that grew: those before line ``first``, and those of the tail that was read again."""
    return previous.filter(F.col("line_no") < first).unionByName(tail.filter(F.col("line_no") >= first))


def merged(lines: DataFrame) -> DataFrame:
    """All sources by time, as a merge of their heads: a line whose time lies before an earlier one of its source follows that one.

    So a line's place is decided by the greatest time so far in its source. Lines without a time have no place and go.
    """
    so_far = _order().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.filter("ts_ns is not null").withColumn("merge_ns", F.max("ts_ns").over(so_far))


def merge_rows(lines: DataFrame, step_ns: int = 3_600_000_000_000) -> DataFrame:
    """The merge with each line's row. Rows are counted within steps of time, and steps by a running sum of their sizes, so no task orders all lines."""
    m = merged(lines).withColumn("step", F.expr(f"merge_ns div {step_ns}"))
    sizes = m.groupBy("step").agg(F.count("*").alias("n"))
    before = sizes.select("step", F.coalesce(F.sum("n").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("step").orderBy("merge_ns", "source_id", "line_no")) - 1
    return m.join(before, "step").withColumn("row", F.col("before") + within).drop("step", "before")
