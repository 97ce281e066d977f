"""Lines as shown: cut at a number of bytes, and marked spans."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loglens.plans.filters import Filter

ELLIPSIS = "…"


def truncated(line: Column, max_bytes: int) -> Column:
    """text and truncated: at most ``max_bytes`` bytes, no character cut through, an ellipsis after what is cut."""
    data = F.encode(line, "UTF-8")
    goes_on = lambda at: F.hex(F.substring(data, at + 1, 1)).between("80", "BF")  # noqa: E731  the byte at a place is no character's first
    first = [n for n in range(max_bytes, max(0, max_bytes - 4), -1)]
    end = F.lit(0)
    for n in reversed(first):
        end = F.when(~goes_on(n), n).otherwise(end)
    beyond = F.coalesce(F.octet_length(line) > max_bytes, F.lit(False))
    cut = F.concat(F.decode(F.substring(data, F.lit(1), end), "UTF-8"), F.lit(ELLIPSIS))
    return F.struct(F.when(beyond, cut).otherwise(F.coalesce(line, F.lit(""))).alias("text"), beyond.alias("truncated"))


def flattened(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(filter, start, end) spans without overlaps: the earlier start wins, then the earlier filter, then the longer span."""
    out, at = [], 0
    for f, start, end in sorted(spans, key=lambda s: (s[1], s[0], -s[2])):
        start = max(start, at)
        if start < end:
            out.append((f, start, end))
            at = end
    return out


def occurrences(data: bytes, keyword: bytes):
    """All places of a keyword, overlapping ones too."""
    at = data.find(keyword)
    while at >= 0:
        yield at, at + len(keyword)
        at = data.find(keyword, at + 1)


def line_spans(line: str, filters: list[Filter]) -> list[tuple[int, int, int]]:
    """Flattened byte spans of the field-mode include filters of one line."""
    import regex

    data, found = line.encode(), []
    low = data.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
    for i, f in enumerate(filters):
        if not f.active or f.excluding or f.mode != "field":
            continue
        if f.regex:
            for m in regex.finditer(f.text, line, 0 if f.case_sensitive else regex.IGNORECASE):
                if m.end() > m.start():
                    start = len(line[: m.start()].encode())
                    found.append((i, start, start + len(m[0].encode())))
        else:
            keyword = f.text.encode()
            if not f.case_sensitive:
                keyword = keyword.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
            found += [(i, a, b) for a, b in occurrences(data if f.case_sensitive else low, keyword)]
    return flattened(found)


def spans(line: Column, filters: list[Filter]) -> Column:
    """Spans of each line, computed in Arrow batches; meant for lines that are shown."""

    @F.pandas_udf("array<struct<filter:int,start:int,end:int>>")
    def found(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: [{"filter": f, "start": a, "end": b} for f, a, b in line_spans(x or "", filters)])

    return found(line)


def remapped(found: list[tuple[int, int]], data: bytes, charset: str, shown: int | None = None) -> list[tuple[int, int]]:
    """Byte spans of a raw line as byte spans of its decoded UTF-8 text, snapped to characters; empty ones go."""
    at, places = 0, [0]
    text = data.decode(charset, "replace")
    ends, raw = [], 0
    for c in text:
        raw += len(c.encode(charset, "replace"))
        at += len(c.encode())
        ends.append(raw)
        places.append(at)
    out = []
    for start, end in found:
        first = sum(e <= start for e in ends)
        last = sum(e < end for e in ends) + (1 if end > 0 and ends else 0)
        a, b = places[min(first, len(ends))], places[min(last, len(ends))]
        if shown is not None:
            a, b = min(a, shown), min(b, shown)
        if a < b:
            out.append((a, b))
    return out
