"""The search box's short syntax: alternatives by |, conjunctions by &, plain terms, field terms and ``t:`` ranges."""

from __future__ import annotations

import re

from loglens.functions.text import quoted
from loglens.functions.times import time_value
from loglens.plans.query import QueryError, compiled

#: What a field term starts with.
_FIELD = re.compile(r"(?:level!?=|lvl=|priority=|[pt]id(?:!?=|[<>])|(?:tag|msg)(?::|!?=|!?~)|(?:message|text|is):)", re.I)


def _is_field(term: str) -> bool:
    if not _FIELD.match(term):
        return False
    try:
        compiled(term)
    except QueryError:
        return False
    return True


def time_range(term: str) -> str | None:
    """``t:A`` or ``t:A B`` as a query: from A on, or from A to B; None if it isn't one."""
    if term[:2].lower() != "t:":
        return None
    words = term[2:].split()
    for n in (2, 1):
        start, end = " ".join(words[:n]), " ".join(words[n:])
        if len(words) < n or len(words) > n + 2 or time_value(start) is None:
            continue
        if not end:
            return f"time>={quoted(start)}"
        if time_value(end) is not None:
            return f"(time>={quoted(start)} and time<={quoted(end)})"
    return None


def expanded(text: str) -> tuple[list[str], str]:
    """The plain keywords, for highlighting, and the query."""
    keywords: list[str] = []

    def term(x: str) -> str:
        found = time_range(x) or (x if _is_field(x) else None)
        if found is None:
            keywords.append(x)
            found = quoted(x)
        return found

    groups = [g for g in ([x for x in map(str.strip, part.split("&")) if x] for part in text.split("|")) if g]
    alternatives = [[term(x) for x in g] for g in groups]
    return keywords, " or ".join(a[0] if len(a) == 1 else f"({' and '.join(a)})" for a in alternatives)
