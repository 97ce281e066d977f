"""One query per operator of the log engine, named by operator, with its DuckDB SQL where SQL can express it.

The log is made from the driver's tables (loglens.sources.tables); the SQL works on the tables' own columns, so that
writing and parsing records are under test too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.functions import text
from loglens.functions.records import level_letter, with_record
from loglens.functions.times import time_value
from loglens.operators import catalog, extract, render, scan, templates, views
from loglens.plans.filters import Filter, FilterSet
from loglens.plans.query import Options
from loglens.plans.searchbox import expanded
from loglens.session import prepared
from loglens.sources import generated, lines, sinks
from loglens.sources.encodings import decoded, encoded, latin1
from loglens.sources.scratch import scratch
from loglens.sources.tables import chat_lines, doc_lines, event_json, event_log, page_lines
from loglens.streaming import tail

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_LETTER = "CASE event_type WHEN 'error' THEN 'E' WHEN 'purchase' THEN 'W' WHEN 'signup' THEN 'I' WHEN 'click' THEN 'D' ELSE 'V' END"
_MSG = "'value=' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) || ' props=' || props"
_EV = f"""ev0 AS (SELECT 0::BIGINT AS source_id, event_id AS line_no, epoch_us(ts) * 1000 AS ts_ns, user_id AS pid, event_id % 1000 AS tid,
    strpos('VDIWEFS', {_LETTER}) - 1 AS level, event_type AS tag, {_MSG} AS msg,
    strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || '  ' || user_id || '  ' || (event_id % 1000) || ' ' || {_LETTER} || ' ' || event_type || ': ' || {_MSG} AS line FROM events),
  ev AS (SELECT *, translate(line, {_AZ}) AS low FROM ev0)"""
_DL = f"""dl0 AS (SELECT doc_id AS source_id, unnest(string_split(regexp_replace(text, '\\n\\z', ''), chr(10))) AS line,
    unnest(range(len(string_split(regexp_replace(text, '\\n\\z', ''), chr(10))))) AS line_no FROM documents WHERE text <> ''),
  dl AS (SELECT *, translate(line, {_AZ}) AS low FROM dl0)"""
KEY = ["source_id", "line_no"]
FILTERS = [Filter("the"), Filter("ing", excluding=False, mode="field"), Filter("thand", excluding=True), Filter("and"), Filter("of", enabled=False), Filter("^Er", regex=True, case_sensitive=True)]
_HITS = ["contains(low, 'the')", "contains(low, 'ing')", "contains(low, 'thand')", "contains(low, 'and')", "false", "regexp_matches(line, '^Er')"]
_INCLUDE = f"({_HITS[0]} OR {_HITS[1]} OR {_HITS[3]} OR {_HITS[5]})"
_VISIBLE = f"({_INCLUDE} AND NOT {_HITS[2]})"
KEYWORDS = [f"{a}{b}" for a in ("th", "er", "on", "an", "re") for b in ("the", "tion", "ing", "wh")]

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    _QUERIES[name] = query
    if sql is not None:
        _SQL[name] = sql


def _event_query(name: str, source: str, where: str, options: Options = Options()) -> None:  # noqa: B008
    """A query over the event log, and what it comes to on the events' own columns."""
    _add(name, lambda s, d: scan.by_query(event_log(s, d), source, options).lines.select("line_no"), f"WITH {_EV} SELECT line_no FROM ev WHERE {where}")


def _doc_query(name: str, source: str, where: str, options: Options = Options()) -> None:  # noqa: B008
    _add(name, lambda s, d: scan.by_query(doc_lines(s, d), source, options).lines.select(*KEY), f"WITH {_DL} SELECT source_id, line_no FROM dl WHERE {where}")


# Sources and sinks.


def _written_events(spark: SparkSession, sf_dir: str) -> str:
    path = scratch(spark, "events")
    sinks.write_lines(event_log(spark, sf_dir), path, end="\r\n")
    return path


def _gb18030(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared(spark)
    raw = F.encode("line", "GB18030")
    return doc_lines(spark, sf_dir).select(*KEY, decoded(raw, "GB18030").alias("line"))


_add("src01_read_lines", lambda s, d: tail.numbered(prepared(s), _written_events(s, d)).select("line_no", "line"), f"WITH {_EV} SELECT line_no, line FROM ev")
_add("src03_decode_gb18030", _gb18030, f"WITH {_DL} SELECT source_id, line_no, line FROM dl")
_add("src07_line_span", lambda s, d: lines.span(event_log(s, d), 100, 50).select("line_no", "line"), f"WITH {_EV} SELECT line_no, line FROM ev WHERE line_no BETWEEN 100 AND 149")
_add("src09_suffix", lambda s, d: lines.suffix(event_log(s, d), 500).select("line_no"), f"WITH {_EV} SELECT line_no FROM ev WHERE line_no >= 500")
_add("src14_ndjson", lambda s, d: extract.json_maps(event_json(s, d)).select("line_no", F.col("m")["k"].alias("k")), "SELECT event_id AS line_no, json_extract_string(props, '$.k') AS k FROM events")
_add("src16_generated", lambda s, d: scan.by_query(generated.generated(s, 12_000), "level=I", Options()).lines.select("line_no"), "SELECT range AS line_no FROM range(12000) WHERE range % 12 = 0")
_add(
    "snk01_json_rows",
    lambda s, d: sinks.json_rows(event_log(s, d)).select("json"),
    f"""WITH {_EV} SELECT '{{"line":' || (line_no + 1) || ',"text":"' || replace(replace(line, '\\', '\\\\'), '"', '\\"') || '","truncated":false}}' AS json FROM ev ORDER BY line_no LIMIT 100""",
)
_add("snk02_filtered_export", lambda s, d: scan.by_filters(doc_lines(s, d), FilterSet(FILTERS)).lines.select("line"), f"WITH {_DL} SELECT line FROM dl WHERE {_VISIBLE}")
_add("snk04_csv", lambda s, d: sinks.csv_rows(event_json(s, d))[1].select("line_no", "csv"), """SELECT event_id AS line_no, CASE WHEN regexp_matches(props, '[,"\\r\\n]') THEN '"' || replace(props, '"', '""') || '"' ELSE props END AS csv FROM events""")

_add("snk08_joined_lines", lambda s, d: sinks.joined(lines.span(chat_lines(s, d), 0, 3)), "SELECT conv_id AS source_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations WHERE turn < 3 GROUP BY 1")
_add("agg12_extraction_metrics", lambda s, d: s.createDataFrame([extract.metrics(event_log(s, d), extract.by_regex(event_log(s, d), "error"))], "scanned long, matched long"), f"WITH {_EV} SELECT count(*) AS scanned, count_if(contains(line, 'error'))::BIGINT AS matched FROM ev")
_add("agg02_counts_ignore_visibility", lambda s, d: scan.counts(event_log(s, d), FilterSet([Filter("click", excluding=True), Filter("view"), Filter("error", enabled=False)])), f"WITH {_EV} SELECT 0::BIGINT AS filter, count_if(contains(low, 'click'))::BIGINT AS n FROM ev UNION ALL SELECT 1::BIGINT, count_if(contains(low, 'view'))::BIGINT FROM ev UNION ALL SELECT 2::BIGINT, 0::BIGINT")

# Scalar functions.
_add(
    "scl01_parse_record",
    lambda s, d: with_record(event_log(s, d)).select("line_no", "ts_ns", "pid", "tid", F.col("level").cast("long").alias("level"), "tag", "msg", "structured"),
    f"WITH {_EV} SELECT line_no, ts_ns, pid, tid, level, tag, msg, true AS structured FROM ev",
)
_add(
    "scl02_timestamp_without_year",
    lambda s, d: with_record(event_log(s, d, year=False)).select("line_no", "ts_ns"),
    "SELECT event_id AS line_no, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) * 1000 AS ts_ns FROM events",
)
_add("scl04_level_letter", lambda s, d: with_record(event_log(s, d)).select("line_no", level_letter(F.col("level")).alias("letter")), f"SELECT event_id AS line_no, {_LETTER} AS letter FROM events")
_add("scl07_base_time", lambda s, d: s.createDataFrame([(scan.inferred_base(event_log(s, d)),)], "ts_ns long"), f"WITH {_EV} SELECT ts_ns FROM ev ORDER BY line_no LIMIT 1")
_add(
    "scl08_bytes_of_literal",
    lambda s, d: doc_lines(s, d).filter(F.contains(latin1(F.encode("line", "UTF-8")), F.lit(encoded("é", "UTF-8").decode("latin-1")))).select(*KEY),
    f"WITH {_DL} SELECT source_id, line_no FROM dl WHERE contains(line, 'é')",
)


def _truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = render.truncated(F.col("line"), 64)
    return doc_lines(spark, sf_dir).select(*KEY, cut.alias("c")).select(*KEY, "c.text", "c.truncated")


_add(
    "scl09_truncate",
    _truncated,
    f"""WITH {_DL}, n AS (SELECT *, list_max(list_concat([0], list_filter(range(0, 65), lambda k: strlen(left(line, k::BIGINT)) <= 64))) AS k FROM dl)
SELECT source_id, line_no, CASE WHEN strlen(line) > 64 THEN left(line, k::BIGINT) || '…' ELSE line END AS text, strlen(line) > 64 AS truncated FROM n""",
)
_add(
    "scl11_message_words",
    lambda s, d: doc_lines(s, d).select(F.explode(text.message_words(F.col("line"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")),
    f"""WITH {_DL}, w AS (SELECT unnest(regexp_split_to_array(line, '[^\\p{{L}}\\p{{N}}_-]+')) AS word FROM dl)
SELECT word, count(*) AS n FROM w WHERE length(word) >= 2 AND NOT regexp_full_match(word, '[0-9]+') GROUP BY word""",
)
_add("scl12_captures", lambda s, d: extract.by_regex(event_log(s, d), r"value=(?P<whole>[0-9]+)\.(?P<part>[0-9]+)").records.select("line_no", "whole", "part"), f"WITH {_EV} SELECT line_no, regexp_extract(msg, 'value=([0-9]+)\\.([0-9]+)', 1) AS whole, regexp_extract(msg, 'value=([0-9]+)\\.([0-9]+)', 2) AS part FROM ev")
_add(
    "scl15_match_rank",
    lambda s, d: event_log(s, d).transform(with_record).select("line_no", text.match_rank(F.col("tag"), "r").cast("long").alias("rank")),
    f"WITH {_EV} SELECT line_no, CASE WHEN starts_with(lower(tag), 'r') THEN 0 WHEN contains(lower(tag), 'r') THEN 1 ELSE 2 END::BIGINT AS rank FROM ev",
)
_add(
    "scl16_subsequence_score",
    lambda s, d: event_log(s, d).transform(with_record).select("line_no", text.subsequence_score(F.col("tag"), "pc").alias("score")),
    f"WITH {_EV} SELECT line_no, CASE WHEN tag LIKE '%p%c%' THEN length(tag) - 2 END AS score FROM ev",
)
_add("scl21_grouped_digits", lambda s, d: event_log(s, d).select("line_no", text.grouped_digits(F.col("line_no") * 1000).alias("shown")), "SELECT event_id AS line_no, format('{:,}', event_id * 1000) AS shown FROM events")

# The query language.
_event_query("prd02_precedence", "level=E or tag:click and not pid<50", "level = 4 OR (contains(tag, 'click') AND NOT pid < 50)")
_event_query("prd02_neighbours_are_joined", 'tag=click "value=4" (pid=1 or pid=2)', "tag = 'click' AND contains(low, 'value=4') AND pid IN (1, 2)")
_event_query("prd03_empty_query", "", "true")
_doc_query("prd04_text", "The", "contains(low, 'the')")
_doc_query("prd04_text_case_sensitive", "The", "contains(line, 'The')", Options(case_sensitive=True))
_event_query("prd05_empty_text", '"" and level=W', "level = 3")
_doc_query("prd06_regex", r"/th(e|is) [a-z]+ing/", "regexp_matches(line, '(?i)th(e|is) [a-z]+ing')")
_event_query("prd07_level_ge", "level>=W", "level >= 3")
_event_query("prd08_pid_tid", "pid>100 tid!=7", "pid > 100 AND tid <> 7")
_event_query("prd09_time_range", 'time>="2024-01-02 00:00:00" and time<"2024-01-03 12:30:00.5"', f"ts_ns >= {time_value('2024-01-02 00:00:00')} AND ts_ns < {time_value('2024-01-03 12:30:00.5')}")
_event_query("prd09_time_of_day", "time<03:04:05", f"ts_ns < {time_value('2024-01-01 03:04:05')}", Options(base=time_value("2024-01-01 00:00:00")))
_event_query("prd10_level_and_tag", "level>=W and tag:err", "level >= 3 AND contains(tag, 'err')")
_event_query("prd10_tag_operators", "tag!=view and tag~^p or tag!~[aeiou]r", "(tag <> 'view' AND regexp_matches(tag, '^p')) OR NOT regexp_matches(tag, '[aeiou]r')")
_event_query("prd11_msg", 'msg:"VALUE=12" or msg~/k": 7\\d/', "contains(translate(msg, " + _AZ + "), 'value=12') OR regexp_matches(msg, 'k\": 7[0-9]')")
_doc_query(
    "prd12_fuzzy",
    "theron",
    """contains(low, 'theron') OR len(list_filter(regexp_split_to_array(low, '[^0-9a-z_\\x{80}-\\x{10FFFF}-]+'),
       lambda w: length(w) > 0 AND ((strlen(w) <= 9 AND w LIKE '%t%h%e%r%o%n%') OR levenshtein(w, 'theron') <= 2))) > 0""",
    Options(fuzzy=True),
)
_event_query("prd13_is_log", "is:log", "true")
_doc_query("prd13_no_record", "not is:log and tag!=x and not level>=V", "true")


def _searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, query = expanded("value=12 & tag:click | level=E & k | t:2024-01-05 00:00:00 2024-01-05 06:00:00")
    return scan.by_query(event_log(spark, sf_dir), query).lines.select("line_no")


_add(
    "prd16_searchbox",
    _searched,
    f"WITH {_EV} SELECT line_no FROM ev WHERE (contains(low, 'value=12') AND contains(tag, 'click')) OR (level = 4 AND contains(low, 'k')) OR ts_ns BETWEEN {time_value('2024-01-05 00:00:00')} AND {time_value('2024-01-05 06:00:00')}",
)

# Filter sets and scans.


def _visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.by_filters(doc_lines(spark, sf_dir), FilterSet(FILTERS)).lines


def _twenty(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = FilterSet([Filter(k) for k in KEYWORDS])
    return scan.by_filters(doc_lines(spark, sf_dir), found).lines.select(*KEY)


_add("flt04_visible", lambda s, d: _visible(s, d).select(*KEY), f"WITH {_DL} SELECT source_id, line_no FROM dl WHERE {_VISIBLE}")
_add("flt04_twenty_keywords", _twenty, f"WITH {_DL} SELECT source_id, line_no FROM dl WHERE {' OR '.join(f"contains(low, '{k}')" for k in KEYWORDS)}")
_add(
    "flt05_matching_filters",
    lambda s, d: doc_lines(s, d).select(*KEY, F.array_join(FilterSet(FILTERS).matching().cast("array<string>"), ",").alias("filters")),
    f"WITH {_DL} SELECT source_id, line_no, array_to_string(list_filter([{', '.join(f"CASE WHEN {h} THEN '{i}' END" for i, h in enumerate(_HITS))}], lambda x: x IS NOT NULL), ',') AS filters FROM dl",
)
_add(
    "flt06_line_filter",
    lambda s, d: doc_lines(s, d).select(*KEY, FilterSet(FILTERS).line_filter().cast("long").alias("filter")),
    f"WITH {_DL} SELECT source_id, line_no, CASE WHEN {_HITS[0]} THEN 0 WHEN {_HITS[3]} THEN 3 WHEN {_HITS[5]} THEN 5 END::BIGINT AS filter FROM dl",
)
_add("flt08_spans", lambda s, d: doc_lines(s, d).select(*KEY, F.explode(render.spans(F.col("line"), [Filter("the", mode="field"), Filter("her", mode="field"), Filter("e ", mode="field")])).alias("s")).select(*KEY, "s.*"))
_add(
    "flt09_scope",
    lambda s, d: scan.by_filters(event_log(s, d, sources=4), FilterSet([Filter("click"), Filter("view", scope="currentfile")], current=2)).lines.select(*KEY),
    "SELECT event_id % 4 AS source_id, event_id // 4 AS line_no FROM events WHERE event_type = 'click' OR (event_type = 'view' AND event_id % 4 = 2)",
)
_add("scn02_query_scan", lambda s, d: scan.by_query(doc_lines(s, d), '"and" or ing').lines.select(*KEY), f"WITH {_DL} SELECT source_id, line_no FROM dl WHERE contains(low, 'and') OR contains(low, 'ing')")
_add("scn03_filters_and_query", lambda s, d: scan.by_both(doc_lines(s, d), FilterSet(FILTERS), "not tion").lines.select(*KEY), f"WITH {_DL} SELECT source_id, line_no FROM dl WHERE {_VISIBLE} AND NOT contains(low, 'tion')")
_add("scn04_filter_counts", lambda s, d: scan.counts(doc_lines(s, d), FilterSet(FILTERS)), f"WITH {_DL} " + " UNION ALL ".join(f"SELECT {i}::BIGINT AS filter, count_if({h})::BIGINT AS n FROM dl" for i, h in enumerate(_HITS)))
_add("scn05_selected_filters", lambda s, d: doc_lines(s, d).filter(FilterSet(FILTERS).selected([False, True, True, False, True, False])).select(*KEY), f"WITH {_DL} SELECT source_id, line_no FROM dl WHERE {_HITS[1]} AND NOT {_HITS[2]}")
_add("scn06_temporary_query", lambda s, d: scan.temporary(doc_lines(s, d), FilterSet(FILTERS), "un").lines.select(*KEY), f"WITH {_DL} SELECT source_id, line_no FROM dl WHERE ({_INCLUDE} OR contains(low, 'un')) AND NOT {_HITS[2]}")
_add("scn10_all_visible", lambda s, d: scan.by_query(event_log(s, d), " ").lines.orderBy("line_no").limit(100).select("line_no"), f"WITH {_EV} SELECT line_no FROM ev ORDER BY line_no LIMIT 100")

# Joins and views.
_MATCH = "contains(low, 'thing')"


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.by_query(doc_lines(spark, sf_dir), "thing").lines.select(*KEY)


def _segments(spark: SparkSession, sf_dir: str, context: int = 2) -> DataFrame:
    totals = doc_lines(spark, sf_dir).groupBy("source_id").agg(F.count("*").alias("total"))
    return views.segments(_matches(spark, sf_dir), totals, context)


_SEGMENTS = f"""t AS (SELECT source_id, count(*) AS total FROM dl GROUP BY 1),
  s AS (SELECT source_id, greatest(0, line_no - 2) AS a, least(total, line_no + 3) AS b FROM dl JOIN t USING (source_id) WHERE {_MATCH}),
  f AS (SELECT *, CASE WHEN a <= lag(b) OVER (PARTITION BY source_id ORDER BY a, b) THEN 0 ELSE 1 END AS fresh FROM s),
  g AS (SELECT *, sum(fresh) OVER (PARTITION BY source_id ORDER BY a, b) AS run FROM f),
  seg AS (SELECT source_id, min(a)::BIGINT AS start, max(b)::BIGINT AS "end" FROM g GROUP BY source_id, run)"""


def _merged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.merge_rows(with_record(event_log(spark, sf_dir, sources=4)))


_FOUR = """four AS (SELECT event_id % 4 AS source_id, event_id // 4 AS line_no, event_id, epoch_us(ts) * 1000 AS ts_ns FROM events),
  m AS (SELECT *, max(ts_ns) OVER (PARTITION BY source_id ORDER BY line_no) AS merge_ns FROM four)"""
_add("jn01_time_merge", lambda s, d: views.merged(with_record(event_log(s, d, sources=4))).select(*KEY, "merge_ns"), f"WITH {_FOUR} SELECT source_id, line_no, merge_ns FROM m")
_add("jn02_merge_rows", lambda s, d: _merged_sources(s, d).select(*KEY, "row"), f"WITH {_FOUR} SELECT source_id, line_no, row_number() OVER (ORDER BY merge_ns, source_id, line_no) - 1 AS row FROM m")
_add(
    "jn04_edits",
    lambda s, d: views.edited(doc_lines(s, d), _matches(s, d).withColumn("edit", F.lit("changed"))).select(*KEY, "line"),
    f"WITH {_DL} SELECT source_id, line_no, CASE WHEN {_MATCH} THEN 'changed' ELSE line END AS line FROM dl",
)
_add("jn04_marks", lambda s, d: views.marked(doc_lines(s, d), _matches(s, d)).select(*KEY, "line"), f"WITH {_DL} SELECT source_id, line_no, line FROM dl WHERE {_MATCH}")
_add("jn05_selected_minus_excluded", lambda s, d: views.minus(scan.by_query(doc_lines(s, d), "the").lines, _matches(s, d)).select(*KEY), f"WITH {_DL} SELECT source_id, line_no FROM dl WHERE contains(low, 'the') AND NOT {_MATCH}")


def _refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    old = scan.by_query(lines.span(log, 0, 700), "click").lines
    return views.refreshed(old, scan.by_query(lines.suffix(log, 690), "click").lines, 690).select("line_no")


_add("jn06_refreshed_tail", _refreshed, f"WITH {_EV} SELECT line_no FROM ev WHERE contains(low, 'click')")
_add("win01_line_numbers", lambda s, d: lines.numbered(chat_lines(s, d).select(F.lit("f").alias("file"), F.col("source_id").alias("block"), F.col("line_no").alias("at"))).select("line_no"), "SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS line_no FROM conversations")
_add("win02_context_segments", lambda s, d: _segments(s, d).select("source_id", "start", "end"), f'WITH {_DL}, {_SEGMENTS} SELECT source_id, start, "end" FROM seg')
_add(
    "win02_context_lines",
    lambda s, d: views.context_lines(doc_lines(s, d), _segments(s, d)).select(*KEY, "row", "starts_segment"),
    f"""WITH {_DL}, {_SEGMENTS} SELECT dl.source_id, line_no, row_number() OVER (PARTITION BY dl.source_id ORDER BY line_no) - 1 AS row, line_no = start AS starts_segment
FROM dl JOIN seg ON dl.source_id = seg.source_id AND line_no >= start AND line_no < "end" """,
)
_add("win03_gap_before", lambda s, d: _segments(s, d).select("source_id", "start", "gap_before"), f'WITH {_DL}, {_SEGMENTS} SELECT source_id, start, start - lag("end", 1, 0) OVER (PARTITION BY source_id ORDER BY start) AS gap_before FROM seg')
_add("win04_next_and_previous", lambda s, d: views.after(_matches(s, d), 3).withColumnRenamed("line_no", "next").join(views.before(_matches(s, d), 3).withColumnRenamed("line_no", "previous"), "source_id", "full"), f"WITH {_DL} SELECT source_id, min(line_no) FILTER (line_no > 3) AS next, max(line_no) FILTER (line_no < 3) AS previous FROM dl WHERE {_MATCH} AND line_no <> 3 GROUP BY 1")
_add(
    "win05_ordinals",
    lambda s, d: views.ranked(_matches(s, d)),
    f"WITH {_DL} SELECT source_id, line_no, row_number() OVER w - 1 AS ordinal, lag(line_no) OVER w AS previous, lead(line_no) OVER w AS next FROM dl WHERE {_MATCH} WINDOW w AS (PARTITION BY source_id ORDER BY line_no)",
)
_add("win06_line_to_row", lambda s, d: views.line_to_row(_matches(s, d), 5), f"WITH {_DL} SELECT source_id, count_if(line_no < 5)::BIGINT AS row FROM dl WHERE {_MATCH} GROUP BY 1")
_add("win06_row_to_line", lambda s, d: views.row_to_line(_matches(s, d), 1), f"WITH {_DL} SELECT source_id, line_no FROM dl WHERE {_MATCH} QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY line_no) = 2")
_add("win08_filter_navigation", lambda s, d: views.after(doc_lines(s, d).filter(FilterSet(FILTERS).hits[5]), 1), f"WITH {_DL} SELECT source_id, min(line_no) AS line_no FROM dl WHERE {_HITS[5]} AND line_no > 1 GROUP BY 1")
_add("win09_next_over_files", lambda s, d: views.around(scan.by_query(chat_lines(s, d), "thing").lines, 3, 2), f"SELECT conv_id AS source_id, turn AS line_no FROM conversations WHERE contains(translate(text, {_AZ}), 'thing') ORDER BY (conv_id, turn) > (3, 2) DESC, conv_id, turn LIMIT 1")
_add("win09_previous_over_files", lambda s, d: views.around(scan.by_query(chat_lines(s, d), "thing").lines, 3, 2, forward=False), f"SELECT conv_id AS source_id, turn AS line_no FROM conversations WHERE contains(translate(text, {_AZ}), 'thing') ORDER BY (conv_id, turn) < (3, 2) DESC, conv_id DESC, turn DESC LIMIT 1")

# Aggregations.
_CATALOG = f"""c0 AS (SELECT line_no, unnest([{{'field': 'level', 'value': substr('VDIWEFS', level + 1, 1)}}, {{'field': 'pid', 'value': pid::VARCHAR}}, {{'field': 'tid', 'value': tid::VARCHAR}}, {{'field': 'tag', 'value': tag}}]) AS x FROM ev
    UNION ALL SELECT line_no, {{'field': 'msg', 'value': w}} FROM (SELECT line_no, unnest(regexp_split_to_array(msg, '[^\\p{{L}}\\p{{N}}_-]+')) AS w FROM ev) WHERE length(w) >= 2 AND NOT regexp_full_match(w, '[0-9]+')),
  c AS (SELECT x.field AS field, x.value AS value, count(*) AS count, max(line_no) AS last_seen FROM c0 GROUP BY ALL)"""


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.values(event_log(spark, sf_dir))


_add("agg01_line_counts", lambda s, d: doc_lines(s, d).groupBy("source_id").agg(F.count("*").alias("n")), f"WITH {_DL} SELECT source_id, count(*) AS n FROM dl GROUP BY 1")
_add("agg03_summary", lambda s, d: scan.summary(_matches(s, d)), f"WITH {_DL} SELECT count(*) AS matches, count(DISTINCT source_id) AS sources FROM dl WHERE {_MATCH}")
_add("agg04_count_in_range", lambda s, d: views.count_in(_matches(s, d), 1, 4), f"WITH {_DL} SELECT source_id, count_if(line_no >= 1 AND line_no < 4)::BIGINT AS n FROM dl WHERE {_MATCH} GROUP BY 1")
_add("agg05_distinct_values", lambda s, d: catalog.distinct_values(event_log(s, d)), f"WITH {_EV}, {_CATALOG} SELECT field, value FROM c WHERE field IN ('level', 'pid', 'tid')")
_add("agg06_heavy_hitters", lambda s, d: catalog.heavy(_catalog(s, d), "msg", 20), f"WITH {_EV}, {_CATALOG} SELECT field, value, count, last_seen FROM c WHERE field = 'msg' ORDER BY count DESC, last_seen DESC, value LIMIT 20")
_add("agg07_catalog", lambda s, d: catalog.merged(_catalog(s, d)), f"WITH {_EV}, {_CATALOG} SELECT field, value, count, last_seen FROM c")
_add("agg08_sampled_parts", lambda s, d: catalog.sampled_parts(event_log(s, d), 3200).select("line_no"), f"WITH {_EV} SELECT line_no FROM ev WHERE line_no % ceil((SELECT count(*) FROM ev) / 32)::BIGINT < 100")
_add("agg09_head_sample", lambda s, d: catalog.sampled_head(event_log(s, d), 300).select("line_no"), f"WITH {_EV} SELECT line_no FROM ev WHERE line_no < 300")
_add("agg10_masked_templates", lambda s, d: templates.masked(event_log(s, d)), f"WITH {_EV} SELECT array_to_string(list_transform(regexp_split_to_array(trim(line), '\\s+'), lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END), ' ') AS template, count(*) AS n FROM ev GROUP BY 1")
_add("agg10_templates", lambda s, d: templates.top(templates.clustered(templates.masked(event_log(s, d)))))
_add("srt02_first_lines", lambda s, d: scan.by_query(event_log(s, d), "click").lines.orderBy("line_no").limit(100).select("line_no"), f"WITH {_EV} SELECT line_no FROM ev WHERE contains(low, 'click') ORDER BY line_no LIMIT 100")
_add(
    "srt03_suggest",
    lambda s, d: catalog.suggest(_catalog(s, d), "level=E & c", 20).select("field", "value", "expression", "score"),
    f"""WITH {_EV}, {_CATALOG} SELECT field, value, 'level=E & ' || CASE WHEN regexp_full_match(value, '[0-9A-Za-z_.-]*') THEN value ELSE '"' || value || '"' END AS expression, length(value) - 1 AS score
FROM c WHERE contains(lower(value), 'c') ORDER BY CASE WHEN starts_with(lower(value), 'c') THEN 0 ELSE 1 END, count DESC, last_seen DESC, score, expression, field LIMIT 20""",
)
_add("srt04_suggest_over_files", lambda s, d: catalog.suggest_over(catalog.values(event_log(s, d, sources=4)), "cli", ["click and view", "other", "tag=click"]), "SELECT unnest(['click', 'tag=click', 'click and view']) AS expression")

# Set operations and extraction.
_add("set01_union", lambda s, d: views.union(_matches(s, d), scan.by_query(doc_lines(s, d), "tion").lines), f"WITH {_DL} SELECT source_id, line_no FROM dl WHERE {_MATCH} UNION SELECT source_id, line_no FROM dl WHERE contains(low, 'tion')")
_add("set02_display", lambda s, d: views.display(doc_lines(s, d), FilterSet(FILTERS).visible(), F.contains(text.folded(F.col("line")), F.lit("thand"))).select(*KEY), f"WITH {_DL} SELECT source_id, line_no FROM dl WHERE {_VISIBLE} OR contains(low, 'thand')")
_add("set03_pinned", lambda s, d: views.pinned(scan.by_query(event_log(s, d), "click").lines, event_log(s, d), 0, 17).select("line_no"), f"WITH {_EV} SELECT line_no FROM ev WHERE contains(low, 'click') OR line_no = 17")
_add("set06_json_keys", lambda s, d: extract.json_maps(event_json(s, d)).select(F.explode(F.map_keys("m")).alias("key")).distinct(), "SELECT DISTINCT unnest(json_keys(props)) AS key FROM events")
_add("ext01_regex_table", lambda s, d: extract.by_regex(page_lines(s, d), r'<html lang="(?P<lang>[a-z]+)".*?<title>([^<]*)').records.select(*KEY, "lang", "group_2"), """WITH p AS (SELECT page_id AS source_id, unnest(string_split(html, chr(10))) AS line, unnest(range(len(string_split(html, chr(10))))) AS line_no FROM pages)
SELECT source_id, line_no, regexp_extract(line, '<html lang="([a-z]+)".*?<title>([^<]*)', 1) AS lang, regexp_extract(line, '<html lang="([a-z]+)".*?<title>([^<]*)', 2) AS group_2 FROM p WHERE regexp_matches(line, '<html lang="([a-z]+)".*?<title>([^<]*)')""")
_add("ext01_line_range", lambda s, d: extract.by_regex(event_log(s, d), r"click", "11-40").records.select("line_no", "match"), f"WITH {_EV} SELECT line_no, 'click' AS match FROM ev WHERE line_no BETWEEN 10 AND 39 AND contains(line, 'click')")
_add("ext02_json_table", lambda s, d: extract.by_json(event_json(s, d)).records.select("line_no", "k"), "SELECT event_id AS line_no, json_extract_string(props, '$.k') AS k FROM events")
_add("ext04_max_rows", lambda s, d: extract.by_regex(event_log(s, d), "error", max_rows=25).records.select("line_no"), f"WITH {_EV} SELECT line_no FROM ev WHERE contains(line, 'error') ORDER BY line_no LIMIT 25")
_add("vw05_toggled_marks", lambda s, d: views.toggled(_matches(s, d), scan.by_query(doc_lines(s, d), "tion").lines), f"WITH {_DL} SELECT source_id, line_no FROM dl WHERE {_MATCH} <> contains(low, 'tion')")


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log written as segments and followed until all has arrived."""
    out = scratch(spark, "stream")
    stream = tail.matching(tail.segments(spark, _written_events(spark, sf_dir)), "level>=W and tag:err")
    tail.stopped(tail.follow(stream.select("pid", "tag", "msg"), f"q{out[-8:]}", path=f"{out}/rows", checkpoint=f"{out}/state"))
    return spark.read.schema("pid long, tag string, msg string").parquet(f"{out}/rows")


_add("str01_followed_query", _streamed, f"WITH {_EV} SELECT pid, tag, msg FROM ev WHERE level >= 3 AND contains(tag, 'err')")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
