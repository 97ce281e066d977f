"""Text predicates and small functions: folding, words, fuzzy match, ranks, ranges, quoting."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase
#: Words of fuzzy patterns: ASCII letters and digits, _ and -, and all beyond ASCII.
WORD = r"[0-9A-Za-z_\-\x{80}-\x{10FFFF}]"
LONGEST_FUZZY = 64


def folded(text: Column) -> Column:
    """A-Z in lower case, nothing else changed."""
    return F.translate(text, _UPPER, _LOWER)


def lowered(text: Column) -> Column:
    """As good as folded() where ASCII keywords are looked for, and much faster: apart from A-Z only two letters have ASCII in their lower case."""
    odd = F.contains(text, F.lit("\u212a")) | F.contains(text, F.lit("\u0130"))
    return F.when(odd, folded(text)).otherwise(F.lower(text))


def with_lowered(lines: DataFrame, name: str = "_low") -> DataFrame:
    """The frame with the lowered line. The generator keeps it from being computed anew for every keyword."""
    return lines.select("*", F.inline(F.array(F.struct(lowered(F.col("line")).alias(name)))))


def fold(text: str) -> str:
    return text.translate(str.maketrans(_UPPER, _LOWER))


def holds(text: Column, keyword: str, case_sensitive: bool = False, low: Column | None = None) -> Column:
    """Substring test, ASCII letters in any case by default. low: the lowered text, if it is at hand."""
    if case_sensitive:
        return F.contains(text, F.lit(keyword))
    if not keyword.isascii():
        return F.contains(folded(text), F.lit(fold(keyword)))
    return F.contains(lowered(text) if low is None else low, F.lit(fold(keyword)))


def fuzzy(text: Column, keyword: str, case_sensitive: bool = False) -> Column:
    """Substring, or for plain words of 3 to 64 bytes a word of the text that is near: a slightly longer word with the keyword's letters in order, or one within a third of its length in edits (distance in bytes)."""
    if not keyword:
        return F.lit(True)
    near = holds(text, keyword, case_sensitive)
    word = keyword if case_sensitive else fold(keyword)
    if not (3 <= len(word.encode()) <= LONGEST_FUZZY and re.fullmatch(r"[0-9A-Za-z_-]+", word)):
        return near
    n = len(word)
    gap, allowed = max(n // 2, 2), max(n // 3, 1)
    # One character for each byte, so that lengths and distances are counted in bytes.
    latin = F.decode(F.encode(text if case_sensitive else folded(text), "UTF-8"), "ISO-8859-1")
    words = F.split(latin, r"[^0-9A-Za-z_\-\x{80}-\x{FF}]+")
    in_order = "(?s).*".join(re.escape(c) for c in word)
    longer = lambda w: (F.length(w) <= n + gap) & w.rlike(in_order)
    edits = lambda w: (F.abs(F.length(w) - n) <= allowed) & (F.levenshtein(w, F.lit(word), allowed) >= 0)
    return near | F.exists(words, lambda w: (F.length(w) > 0) & (longer(w) | edits(w)))


def message_words(msg: Column) -> Column:
    """Words of a message: letters, digits, _ and -, two characters or more, not all ASCII digits."""
    return F.filter(F.split(msg, r"[^\p{IsAlphabetic}\p{N}_\-]+"), lambda w: (F.char_length(w) >= 2) & ~w.rlike(r"\A[0-9]+\z"))


def match_rank(value: Column, typed: str) -> Column:
    """0 where the value starts with what is typed (or nothing is), 1 where it holds it, else 2; any case."""
    if not typed:
        return F.lit(0)
    low = F.lower(value)
    return F.when(low.startswith(typed.lower()), 0).when(F.contains(low, F.lit(typed.lower())), 1).otherwise(2)


def subsequence_score(value: Column, typed: str) -> Column:
    """A fuzzy score, smaller better: characters of the value beyond those typed; null where the typed ones don't occur in order."""
    if not typed:
        return F.lit(0).cast("long")
    in_order = "(?s)(?iu)" + ".*".join(re.escape(c) for c in typed)
    return F.when(value.rlike(in_order), (F.char_length(value) - len(typed)).cast("long"))


def grouped_digits(number: Column) -> Column:
    return F.format_number(number, 0)


def quoted(text: str) -> str:
    """A query literal."""
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def completion(value: str) -> str:
    """The value as a completion: quoted unless it is letters, digits, _, - and dots of ASCII."""
    return value if re.fullmatch(r"[0-9A-Za-z_.-]*", value) else quoted(value)


def completion_column(value: Column) -> Column:
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(value.rlike(r"\A[0-9A-Za-z_.\-]*\z"), value).otherwise(F.concat(F.lit('"'), escaped, F.lit('"')))


def fragment(typed: str) -> tuple[str, str]:
    """What stands before the last & or | outside quotes and /regex/, spaces included, and the rest."""
    closer, i, start = "", 0, 0
    while i < len(typed):
        c = typed[i]
        if closer:
            if c == "\\":
                i += 1
            elif c == closer:
                closer = ""
        elif c in "\"'/":
            closer = c
        elif c in "&|":
            i += typed[i + 1 : i + 2] == c
            start = i + 1
        i += 1
    start += len(typed[start:]) - len(typed[start:].lstrip())
    return typed[:start], typed[start:]


def line_range(text: str) -> tuple[int, int] | None:
    """``a-b``, lines from 1 and both included, as a half-open range from 0; None if it isn't one."""
    m = re.fullmatch(r"\s*(\d+)\s*-\s*(\d+)\s*", text)
    if not m:
        return None
    first, last = max(int(m[1]), 1), int(m[2])
    return (first - 1, last) if last >= first else None


def color(text: str) -> int | None:
    m = re.fullmatch(r"#?([0-9A-Fa-f]{6})", text.strip())
    return int(m[1], 16) if m else None


def flag(text: str) -> bool:
    return text.strip() in ("y", "Y", "yes", "true", "True", "TRUE", "1")


def fnv1a64(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h
