"""Structured records: timestamp, process, thread, level, tag and message of a line.

One possessive regular expression splits a line; its groups are typed by arithmetic, as calendar functions would
reject second 60 and days that roll over. Timestamps are nanoseconds since 1970 (the year of lines without one).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECORD = (
    r"(?s)\A(?:([0-9]{4})-)?+([0-9]{2})-([0-9]{2}) ([0-9]{2}):([0-9]{2}):([0-9]{2})(?:[.:]([0-9]++))?+ *+"
    r"(?:([0-9]++) *+([0-9]++) *+([VDIWEFSvdiwefs]) ++(?:(?=.*?:(?: |\z))(.*?):(?=(?: |\z))|([^:]*+):) ?+(.*)"
    r"|([VDIWEFSvdiwefs])/([^(]*+)\( *+([0-9]++) *+\): ?+(.*))\z"
)
#: Level letters in order, and names by letter.
LEVELS = "VDIWEFS"
LEVEL_NAMES = {"v": 0, "verbose": 0, "trace": 0, "d": 1, "debug": 1, "i": 2, "info": 2, "w": 3, "warn": 3, "warning": 3, "e": 4, "error": 4, "err": 4, "f": 5, "fatal": 5, "assert": 5, "s": 6, "silent": 6}
SHORTEST = 24
DAY_NS = 86_400_000_000_000
_CUT, _FIRST = "\u0001", "\u0002"
FIELDS = ["ts_ns", "pid", "tid", "level", "tag", "msg", "structured"]


def level_of(text: str) -> int | None:
    """Ordinal of a level's letter or name in any case."""
    return LEVEL_NAMES.get(text.lower())


def level_letter(level: Column) -> Column:
    return F.when(level.between(0, 6), F.substring(F.lit(LEVELS), level.cast("int") + 1, F.lit(1)))


def days(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970 of a proleptic Gregorian date; days past a month's end run on into the next."""
    first = F.make_date(year, month, F.lit(1))
    return F.unix_date(first).cast("long") + day - 1


def _number(digits: Column) -> Column:
    """Decimal digits modulo 2^32; the last 32 digits decide it."""
    return F.when(digits != "", (F.right(digits, F.lit(32)).cast("decimal(38,0)") % F.lit(1 << 32)).cast("long"))


_ORDER = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 14, 16]


def pieces(line: Column) -> Column:
    """The groups of a record as an array: typed ones, then tag and message; null for other lines."""
    cut = F.regexp_replace(line, F.lit(RECORD), F.lit(_FIRST + _CUT.join(f"${g}" for g in _ORDER) + _CUT + "$11$12$15" + _CUT + "$13$17"))
    # A record starts with a digit, so what starts with the mark without having had it has been replaced.
    found = F.when(cut.startswith(_FIRST) & ~line.startswith(_FIRST) & (F.octet_length(line) >= SHORTEST), cut)
    return F.split(F.substring(found, 2, 1 << 30), _CUT, len(_ORDER) + 2)


def fields(line: Column, parts: Column) -> list[Column]:
    """FIELDS from the pieces. Lines that are no record have the line as msg, an empty tag and nulls."""
    whole = {g: F.regexp_extract(line, RECORD, g) for g in (11, 12, 13, 15, 17)}
    odd = F.contains(line, F.lit(_CUT))  # the mark between pieces occurs in the line
    at = lambda i: F.get(parts, F.lit(i))
    tag = F.when(odd, F.concat(whole[11], whole[12], whole[15])).otherwise(at(12))
    msg = F.when(odd, F.concat(whole[13], whole[17])).otherwise(at(13))
    year = F.when(at(0) != "", at(0)).otherwise("1970").cast("int")
    month, day, hour, minute, second = (at(i).try_cast("int") for i in range(1, 6))
    sound = month.between(1, 12) & day.between(1, 31) & (hour <= 23) & (minute <= 59) & (second <= 60)
    seconds = days(year, F.when(month.between(1, 12), month).otherwise(1), day) * 86_400 + hour * 3600 + minute * 60 + second
    exact = seconds.cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)") + F.rpad(F.left(at(6), F.lit(9)), 9, "0").try_cast("decimal(9,0)")
    fits = exact.between(F.lit(-(1 << 63)).cast("decimal(20,0)"), F.lit((1 << 63) - 1).cast("decimal(20,0)"))
    good = F.coalesce(sound & fits, F.lit(False))
    when = lambda c: F.when(good, c)
    return [
        when(exact).cast("long").alias("ts_ns"),
        when(_number(F.concat(at(7), at(11)))).alias("pid"),
        when(_number(at(8))).alias("tid"),
        when(F.instr(F.lit(LEVELS), F.upper(F.concat(at(9), at(10)))) - 1).cast("tinyint").alias("level"),
        F.coalesce(when(F.rtrim(tag)), F.lit("")).alias("tag"),
        F.when(good, msg).otherwise(line).alias("msg"),
        good.alias("structured"),
    ]


def with_record(lines: DataFrame, line: str = "line") -> DataFrame:
    """The frame with FIELDS. The generator keeps the regular expression from being repeated by what uses the fields."""
    kept = [c for c in lines.columns if c not in FIELDS]
    cut = lines.select(*kept, F.inline(F.array(F.struct(pieces(F.col(line)).alias("_pieces")))))
    return cut.select(*kept, *fields(F.col(line), F.col("_pieces")))
