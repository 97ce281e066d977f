"""The boolean query language: text to a tree, and the tree to one column.

``or`` binds weaker than ``and``, that weaker than ``not``; neighbouring terms are joined by ``and``. Logic is
two-valued: a comparison with a missing field is false, and its negation true. Children of a node are ordered from
cheap to dear, so that Spark's short-circuit evaluation reaches regular expressions last.
"""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loglens.functions.records import level_of
from loglens.functions.regexes import PatternError, java
from loglens.functions.text import fuzzy, holds
from loglens.functions.times import time_value

MOST_TERMS = 256
_SYMBOLS = {"&&": "and", "&": "and", "||": "or", "|": "or", "!=": "!=", "!~": "!~", "!": "not", "==": "=", "=": "=", ">=": ">=", ">": ">", "<=": "<=", "<": "<", "~": "~", ":": ":", "(": "(", ")": ")"}
_SYMBOL = re.compile("|".join(re.escape(s) for s in sorted(_SYMBOLS, key=len, reverse=True)))
_BARE = re.compile(r"""[^\s()"'/=!<>~:&|]+""")
_COMPARE = {"=": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
_ALIASES = {"lvl": "level", "priority": "level", "ts": "time", "message": "msg", "text": "msg"}


class QueryError(ValueError):
    """A query that can't be read."""


@dataclass(frozen=True)
class Options:
    """How text compares, the time base of bare times, and whether plain text is matched fuzzily."""

    case_sensitive: bool = False
    base: int | None = None
    fuzzy: bool = False


@dataclass
class Term:
    """A leaf: text, regex, or a field comparison."""

    kind: str
    value: str
    name: str = ""
    op: str = ""
    regex: bool = False


@dataclass
class Branch:
    kind: str  # and, or, not
    children: list = field(default_factory=list)


def _delimited(source: str, at: int) -> tuple[str, int]:
    """The literal whose opening quote or slash is at ``at``, and where it ends."""
    close, out, i = source[at], [], at + 1
    while i < len(source):
        c, following = source[i], source[i + 1 : i + 2]
        if c == close:
            return "".join(out), i + 1
        if c == "\\" and following and (following == close or (close != "/" and following == "\\")):
            out.append(following)
            i += 2
        elif c == "\\" and following and close == "/":
            out.append(c + following)
            i += 2
        else:
            out.append(c)
            i += 1
    raise QueryError("a regex is not closed" if close == "/" else "a quote is not closed")


def tokens(source: str) -> list[tuple[str, str]]:
    """(kind, text): word, regex, or a symbol's own name."""
    out, i = [], 0
    while i < len(source):
        c = source[i]
        if c.isspace():
            i += 1
        elif c in "\"'/":
            text, i = _delimited(source, i)
            out.append(("regex" if c == "/" else "word", text))
        elif m := _SYMBOL.match(source, i):
            out.append((_SYMBOLS[m[0]], m[0]))
            i = m.end()
        else:
            word = _BARE.match(source, i)[0]
            i += len(word)
            out.append((word.lower(), word) if word.lower() in ("and", "or", "not") else ("word", word))
    return out


class _Reader:
    def __init__(self, found: list[tuple[str, str]]):
        self.found, self.at = found, 0

    def kind(self) -> str:
        return self.found[self.at][0] if self.at < len(self.found) else ""

    def take(self) -> tuple[str, str]:
        self.at += 1
        return self.found[self.at - 1]

    def either(self):
        parts = [self.both()]
        while self.kind() == "or":
            self.take()
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Branch("or", parts)

    def both(self):
        parts = [self.one()]
        while (k := self.kind()) in ("and", "word", "regex", "(", "not"):
            if k == "and":
                self.take()
            parts.append(self.one())
        return parts[0] if len(parts) == 1 else Branch("and", parts)

    def one(self):
        k = self.kind()
        if k == "not":
            self.take()
            return Branch("not", [self.one()])
        if k == "(":
            self.take()
            inner = self.either()
            if self.kind() != ")":
                raise QueryError("a parenthesis is not closed")
            self.take()
            return inner
        if k == "regex":
            return Term("regex", self.take()[1])
        if k != "word":
            raise QueryError(f"a condition is missing before {k or 'the end'}")
        word = self.take()[1]
        op = self.kind()
        if op not in (*_COMPARE, "~", "!~", ":"):
            return Term("text", word)
        self.take()
        if self.kind() not in ("word", "regex"):
            raise QueryError(f"{word}{op} lacks a value")
        kind, value = self.take()
        if kind == "word" and word.lower() in ("time", "ts") and op in _COMPARE:
            while self.kind() == ":":
                self.take()
                if self.kind() != "word":
                    raise QueryError("a time is not complete")
                value += ":" + self.take()[1]
        return Term("field", value, word, op, kind == "regex")


def tree(source: str):
    """The query as Terms and Branches; None for an empty one."""
    if not source.strip():
        return None
    reader = _Reader(tokens(source))
    found = reader.either()
    if reader.kind():
        raise QueryError(f"what follows the query makes no sense: {reader.found[reader.at][1]!r}")
    return found


@dataclass
class Query:
    """A compiled query: its column, and whether that needs record fields."""

    column: Column
    needs_fields: bool
    empty: bool = False


class _Compiler:
    def __init__(self, options: Options):
        self.options, self.terms, self.needs_fields = options, 0, False

    def pattern(self, text: str) -> str:
        try:
            return java(text, not self.options.case_sensitive)
        except PatternError as e:
            raise QueryError(f"/{text}/: {e}") from None

    def column(self, node) -> tuple[Column, int]:
        """The column, and how dear it is."""
        if isinstance(node, Term):
            return self.term(node)
        parts = sorted((self.column(c) for c in node.children), key=lambda x: x[1])
        dear = sum(d for _, d in parts)
        if node.kind == "not":
            return ~parts[0][0], dear
        return reduce(operator.and_ if node.kind == "and" else operator.or_, (c for c, _ in parts)), dear

    def term(self, t: Term) -> tuple[Column, int]:
        if t.kind == "text" and not t.value:
            return F.lit(True), 0
        self.terms += 1
        if self.terms > MOST_TERMS:
            raise QueryError(f"a query has at most {MOST_TERMS} conditions")
        if t.kind == "regex":
            return F.coalesce(F.col("line").rlike(self.pattern(t.value)), F.lit(False)), 20
        if t.kind == "text":
            found = (fuzzy if self.options.fuzzy else holds)(F.col("line"), t.value, self.options.case_sensitive)
            return F.coalesce(found, F.lit(False)), 40 if self.options.fuzzy else 3
        self.needs_fields = True
        name = _ALIASES.get(t.name.lower(), t.name.lower())
        if name in ("tag", "msg"):
            return self.of_text(name, t)
        if name == "is":
            if t.value.lower() not in ("log", "structured"):
                raise QueryError("is: has log alone")
            return F.col("structured"), 1
        read = {"level": level_of, "pid": _unsigned, "tid": _unsigned, "time": lambda v: time_value(v, self.options.base)}.get(name)
        if not read:
            raise QueryError(f"there is no field {t.name}")
        if (value := read(t.value)) is None:
            raise QueryError(f"{t.value!r} is no {name}")
        if t.op not in _COMPARE:
            raise QueryError(f"{name} has no operator {t.op}")
        return F.coalesce(_COMPARE[t.op](F.col("ts_ns" if name == "time" else name), F.lit(value)), F.lit(False)), 1

    def of_text(self, name: str, t: Term) -> tuple[Column, int]:
        if t.regex or t.op in ("~", "!~"):
            found, dear = F.col(name).rlike(self.pattern(t.value)), 20
        elif t.op in ("=", "!="):
            found, dear = F.col(name) == F.lit(t.value), 1
        elif t.op == ":":
            found, dear = holds(F.col(name), t.value, self.options.case_sensitive), 3
        else:
            raise QueryError(f"{name} has no operator {t.op}")
        found = F.coalesce(found, F.lit(False))
        return (~found if t.op in ("!=", "!~") else found), dear


def _unsigned(text: str) -> int | None:
    return int(text) if re.fullmatch(r"\+?[0-9]+", text) and int(text) < 1 << 32 else None


def compiled(source: str, options: Options = Options()) -> Query:  # noqa: B008
    """A query over the columns ``line`` and, where it needs_fields, those of with_record()."""
    found = tree(source)
    if found is None:
        return Query(F.lit(True), False, True)
    compiler = _Compiler(options)
    column, _ = compiler.column(found)
    return Query(column, compiler.needs_fields)
