"""Filter sets: ordered include and exclude filters as columns."""

from __future__ import annotations

import operator
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.functions.regexes import java
from loglens.functions.text import holds, with_lowered



@dataclass(frozen=True)
class Filter:
    """One filter; its place in the list is its priority."""

    text: str = ""
    enabled: bool = True
    excluding: bool = False
    regex: bool = False
    case_sensitive: bool = False
    description: str = ""
    group: str = ""
    kind: str = "matches_text"
    fore: int | None = None
    back: int | None = None
    bold: bool = False
    italic: bool = False
    font_size: int | None = None
    mode: str = "line"  # or field: only the hit is marked
    scope: str = "allfiles"  # or currentfile
    extra: tuple[tuple[str, str], ...] = field(default=())

    @property
    def active(self) -> bool:
        return self.enabled and self.text != ""


def hit(f: Filter, line: Column | None = None, current: int | None = None, source: str = "source_id", low: Column | None = None) -> Column:
    """Whether a filter hits a line. current: the source to which filters of that scope are confined."""
    if not f.active:
        return F.lit(False)
    text = F.col("line") if line is None else line
    found = text.rlike(java(f.text, not f.case_sensitive)) if f.regex else holds(text, f.text, f.case_sensitive, low)
    if f.scope == "currentfile" and current is not None:
        found = (F.col(source) == current) & found
    return F.coalesce(found, F.lit(False))


def any_of(columns: list[Column]) -> Column:
    return reduce(operator.or_, columns) if columns else F.lit(False)


class FilterSet:
    """The columns of a list of filters."""

    def __init__(self, filters: list[Filter], current: int | None = None, low: Column | None = None):
        self.filters, self.current = list(filters), current
        self.hits = [hit(f, current=current, low=low) for f in self.filters]

    def ready(self, lines: DataFrame) -> tuple[DataFrame, FilterSet]:
        """The lines, lowered once if several keywords look at that, and the set that reads them so."""
        keywords = sum(f.active and not f.regex and not f.case_sensitive for f in self.filters)
        if keywords < 2:
            return lines, self
        return with_lowered(lines), FilterSet(self.filters, self.current, F.col("_low"))

    @property
    def restricts(self) -> bool:
        return any(f.active for f in self.filters)

    def _of(self, excluding: bool, among=None) -> list[Column]:
        return [h for i, (f, h) in enumerate(zip(self.filters, self.hits, strict=True)) if f.active and f.excluding == excluding and (among is None or among[i])]

    def visible(self) -> Column:
        """An include filter hits, or there is none; and no exclude filter does."""
        include, exclude = self._of(False), self._of(True)
        return (any_of(include) if include else F.lit(True)) & ~any_of(exclude)

    def visible_with(self, query: Column) -> Column:
        """A query typed for the moment: another include filter, or the only condition beside the excludes."""
        include = self._of(False)
        return (any_of([*include, query]) if include else query) & ~any_of(self._of(True))

    def selected(self, chosen: list[bool]) -> Column:
        """Lines that a chosen include filter hits and no chosen exclude filter does, whatever else holds."""
        return any_of(self._of(False, chosen)) & ~any_of(self._of(True, chosen))

    def matching(self) -> Column:
        """The filters that hit, by place."""
        return F.array_compact(F.array(*[F.when(h, F.lit(i)) for i, h in enumerate(self.hits)])) if self.hits else F.array().cast("array<int>")

    def line_filter(self) -> Column:
        """The first include filter in line mode that hits; null without one."""
        which = [F.when(h, F.lit(i)) for i, (f, h) in enumerate(zip(self.filters, self.hits, strict=True)) if f.active and not f.excluding and f.mode == "line"]
        return F.array_min(F.array(*which)) if which else F.lit(None).cast("int")

    def counts(self) -> list[Column]:
        """Lines that each filter hits, hidden ones too; one pass serves all."""
        return [F.count_if(h).alias(f"n_{i}") for i, h in enumerate(self.hits)]


def grouped(filters: list[Filter]) -> list[tuple[str, list[Filter]]]:
    """Groups in the order of their first filters."""
    out: dict[str, list[Filter]] = {}
    for f in filters:
        out.setdefault(f.group, []).append(f)
    return list(out.items())


def moved(filters: list[Filter], chosen: set[int], to: int) -> list[Filter]:
    """The chosen filters, in their order, before place ``to`` of the list as it is."""
    taken = [f for i, f in enumerate(filters) if i in chosen]
    before = [f for i, f in enumerate(filters) if i < to and i not in chosen]
    return [*before, *taken, *(f for i, f in enumerate(filters) if i >= to and i not in chosen)]


def toggled(filters: list[Filter]) -> list[Filter]:
    """All on; all off if they were all on."""
    on = not all(f.enabled for f in filters)
    return [replace(f, enabled=on) for f in filters]


def style(filters: list[Filter], line_filter: int | None, spans: list[tuple[int, int, int]]) -> int | None:
    """Font size of a line: its line filter's, else that of the first span's filter."""
    if line_filter is not None:
        return filters[line_filter].font_size
    return filters[spans[0][0]].font_size if spans else None
