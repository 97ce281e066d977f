"""Field values of records with their frequencies, and completions from them.

Counts are exact: a grouped count is combined before the shuffle and spills, so values need no bound in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.functions.records import level_letter, with_record
from loglens.functions.text import completion_column, fragment, match_rank, message_words, subsequence_score

#: Fields in the order of suggestions, and the names under which they are typed.
FIELDS = ["level", "tag", "pid", "tid", "msg"]
NAMES = {"level": "level", "lvl": "level", "priority": "level", "tag": "tag", "pid": "pid", "tid": "tid", "msg": "msg", "message": "msg", "text": "msg"}
HEAD_LINES, PARTS = 1_000_000, 32


def sampled_head(lines: DataFrame, most: int = HEAD_LINES) -> DataFrame:
    """The first lines of every source."""
    return lines.filter(F.col("line_no") < most)


def sampled_parts(lines: DataFrame, most: int, parts: int = PARTS) -> DataFrame:
    """An even share of lines from each of up to ``parts`` stretches of every source (a sampling operator)."""
    size = lines.groupBy("source_id").agg((F.max("line_no") + 1).alias("total"))
    stretch = F.ceil(F.col("total") / parts).cast("long")
    return lines.join(size, "source_id").filter((F.col("line_no") % stretch) < max(1, most // parts)).drop("total")


def values(lines: DataFrame, of_messages: bool = True) -> DataFrame:
    """source_id, field, value, count, last_seen (line); of_messages: words of messages too."""
    records = lines if "structured" in lines.columns else with_record(lines)
    item = lambda name, value: F.struct(F.lit(name).alias("field"), value.cast("string").alias("value"))
    fixed = [item("level", level_letter(F.col("level"))), item("pid", F.col("pid")), item("tid", F.col("tid")), item("tag", F.when(F.col("tag") != "", F.col("tag")))]
    words = F.transform(message_words(F.col("msg")), lambda w: F.struct(F.lit("msg").alias("field"), w.alias("value")))
    exploded = records.select("source_id", "line_no", F.explode(F.concat(F.array(*fixed), words) if of_messages else F.array(*fixed)).alias("x")).select("source_id", "line_no", "x.*")
    return exploded.filter("value is not null").groupBy("source_id", "field", "value").agg(F.count("*").alias("count"), F.max("line_no").alias("last_seen"))


def distinct_values(lines: DataFrame) -> DataFrame:
    """Levels, process and thread ids that occur."""
    return values(lines, of_messages=False).filter(F.col("field").isin("level", "pid", "tid")).select("field", "value").distinct()


def merged(found: DataFrame) -> DataFrame:
    """Catalogs of all sources as one."""
    return found.groupBy("field", "value").agg(F.sum("count").alias("count"), F.max("last_seen").alias("last_seen"))


def heavy(found: DataFrame, field: str, most: int) -> DataFrame:
    """The most frequent values of a field (a top-k report)."""
    return merged(found).filter(F.col("field") == field).orderBy(F.desc("count"), F.desc("last_seen"), "value").limit(most)


def typed_field(text: str) -> tuple[str | None, str]:
    """The field that a fragment such as ``tag:ab`` or ``level=`` names, and what is typed of its value."""
    for i, c in enumerate(text):
        if c in "=:~!<>":
            name = NAMES.get(text[:i].strip().lower())
            return (name, text[i:].lstrip("=:~!<>").lstrip().lstrip("\"'")) if name else (None, text.lstrip("\"'"))
    return None, text.lstrip("\"'")


def ranked(found: DataFrame, typed: str) -> tuple[str, DataFrame]:
    """What stands before the active fragment, and candidates with rank and score."""
    before, part = fragment(typed)
    name, start = typed_field(part)
    score = subsequence_score(F.col("value"), start)
    some = found if name is None else found.filter(F.col("field") == name)
    return before, some.withColumns({"rank": match_rank(F.col("value"), start).cast("long"), "score": score}).filter("score is not null")


def suggest(found: DataFrame, typed: str, limit: int = 20) -> DataFrame:
    """field, value, expression, score: best rank, then most frequent, then last seen (a top-k report)."""
    before, some = ranked(merged(found), typed)
    expression: Column = F.concat(F.lit(before), completion_column(F.col("value")))
    out = some.withColumn("expression", expression).orderBy("rank", F.desc("count"), F.desc("last_seen"), "score", "expression", "field").limit(limit)
    return out.select("field", "value", "expression", "score")


def suggest_over(found: DataFrame, typed: str, history: list[str] = (), limit: int = 16) -> DataFrame:
    """Expressions from all sources, each once, then searches of before that match (a top-k report)."""
    before, some = ranked(found, typed)
    best = some.withColumn("expression", F.concat(F.lit(before), completion_column(F.col("value")))).groupBy("expression").agg(F.min(F.struct("rank", "score", "source_id")).alias("at"))
    mine = best.select("expression", F.lit(0).alias("kind"), "at.rank", "at.score", "at.source_id")
    spark = found.sparkSession
    old = spark.createDataFrame([(h, i) for i, h in enumerate(dict.fromkeys(history))], "expression string, source_id long")
    old = old.withColumn("score", subsequence_score(F.col("expression"), typed.strip())).filter("score is not null").join(mine.select("expression"), "expression", "left_anti")
    both = mine.unionByName(old.select("expression", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("rank"), "score", "source_id"))
    return both.orderBy("kind", "rank", "score", "source_id", "expression").limit(limit).select("expression")


def most_recent(found: list[str], new: str, most: int) -> list[str]:
    """A most-recent-first list with one more entry, each once."""
    return [new, *(x for x in found if x != new)][:most]
