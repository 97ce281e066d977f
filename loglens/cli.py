"""Command line: info, read, query, filter, suggest, config."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from loglens.operators import catalog, scan
from loglens.plans.filters import FilterSet
from loglens.session import prepared, session
from loglens.sources import config, lines, sinks
from loglens.sources.encodings import detected, named


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loglens", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, more in {"info": [], "read": [], "query": ["expression"], "filter": ["config"], "suggest": ["typed"], "config": []}.items():
        c = sub.add_parser(name)
        c.add_argument("path")
        for m in more:
            c.add_argument(m)
        c.add_argument("--encoding")
        c.add_argument("--line", type=int, default=1)
        c.add_argument("--count", type=int)
        c.add_argument("--max-lines", type=int, default=sinks.MAX_LINES)
        c.add_argument("--max-bytes", type=int, default=sinks.MAX_BYTES)
        c.add_argument("--limit", type=int, default=20)
        c.add_argument("--json", action="store_true")
    return p


def run(arguments: list[str], spark: SparkSession | None = None) -> list[str]:
    """The lines that a command prints."""
    a = parser().parse_args(arguments)
    if a.command == "config":
        return [config.write_json(config.read(a.path))]
    spark = prepared(spark or session())
    log = lines.read(spark, a.path, a.encoding)
    if a.command == "info":
        label, mark = detected(lines.head(spark, a.path))
        return [json.dumps({"path": a.path, "file_name": a.path.rpartition("/")[2], "bytes": lines.size(spark, a.path), "encoding": named(a.encoding) if a.encoding else label, "bom_bytes": mark, "lines": log.count()})]
    if a.command == "suggest":
        return [json.dumps(r.asDict()) for r in catalog.suggest(catalog.values(catalog.sampled_head(log)), a.typed, a.limit).collect()]
    if a.command == "read":
        first = max(a.line, 1) - 1
        found = lines.span(log, first, a.max_lines if a.count is None else a.count)
    elif a.command == "query":
        found = scan.by_query(log, a.expression).lines
    else:
        found = scan.by_filters(log, FilterSet(config.read(a.config).filters)).lines
    limit = None if a.command == "read" else a.max_lines
    rows = sinks.json_rows(found.select("source_id", "line_no", "line"), limit, a.max_bytes).orderBy("source_id", "line_no").collect()
    out = [r.json for r in rows]
    return ["[" + ",".join(out) + "]"] if a.command == "read" and a.json else out


def main() -> None:
    import sys

    for x in run(sys.argv[1:]):
        print(x)


if __name__ == "__main__":
    main()
