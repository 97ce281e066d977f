import itertools
import json

import pytest
from pyspark.sql import functions as F

from loglens import cli
from loglens.operators import catalog, extract, render, scan, templates, views
from loglens.plans import filters as filters_module
from loglens.plans.filters import Filter, FilterSet
from loglens.session import prepared
from loglens.sources import config, lines, sinks
from loglens.sources.encodings import ENCODINGS, EncodingError, decoded, detected, named
from loglens.streaming import capture, tail


def frame(spark, texts, source=0):
    return spark.createDataFrame([(source, i, x) for i, x in enumerate(texts)], "source_id long, line_no long, line string")


def numbers(df):
    return sorted(r.line_no for r in df.select("line_no").collect())


FOUR = ["Open door", "open window", "close door", "nothing", "DOOR"]


def test_filter_sets(spark):
    log = frame(spark, FOUR)
    include, exclude = Filter("door"), Filter("close", excluding=True)
    assert numbers(scan.by_filters(log, FilterSet([include, exclude])).lines) == [0, 4]
    assert numbers(scan.by_filters(log, FilterSet([exclude])).lines) == [0, 1, 3, 4]
    assert not scan.by_filters(log, FilterSet([Filter("x", enabled=False), Filter("")])).restricted
    every = FilterSet([include, exclude, Filter("O[pd]", regex=True, case_sensitive=True), Filter("x", enabled=False)])
    assert [r.n for r in scan.counts(log, every).orderBy("filter").collect()] == [3, 1, 1, 0]
    assert numbers(scan.temporary(log, FilterSet([include, exclude]), "nothing").lines) == [0, 3, 4]
    assert numbers(scan.temporary(log, FilterSet([exclude]), "door").lines) == [0, 4]
    assert numbers(scan.by_both(log, FilterSet([include]), "open").lines) == [0]
    assert numbers(log.filter(every.selected([False, True, True, False]))) == [0]
    assert [r[0] for r in log.select(every.matching()).collect()] == [[0, 2], [], [0, 1], [], [0]]


def test_filter_lists():
    a, b, c = Filter("a", group="x"), Filter("b"), Filter("c", group="x", enabled=False)
    assert [g for g, _ in filters_module.grouped([a, b, c])] == ["x", ""]
    assert filters_module.moved([a, b, c], {2}, 0) == [c, a, b] and filters_module.moved([a, b, c], {0}, 2) == [b, a, c]
    assert all(f.enabled for f in filters_module.toggled([a, c])) and not any(f.enabled for f in filters_module.toggled([a, b]))
    assert filters_module.style([Filter("a", font_size=9), Filter("b", font_size=7)], None, [(1, 0, 2)]) == 7


def test_spans():
    assert render.flattened([(1, 0, 4), (0, 2, 6), (2, 3, 5)]) == [(1, 0, 4), (0, 4, 6)]
    assert render.line_spans("aaa é aa", [Filter("AA", mode="field"), Filter("é", mode="field", case_sensitive=True), Filter("a", mode="line")]) == [(0, 0, 2), (0, 2, 3), (1, 4, 6), (0, 7, 9)]
    for triple in itertools.product(itertools.combinations(range(5), 2), repeat=2):
        flat = render.flattened([(i, a, b) for i, (a, b) in enumerate(triple)])
        covered = [x for _, a, b in flat for x in range(a, b)]
        assert len(covered) == len(set(covered)) and set(covered) == {x for a, b in triple for x in range(a, b)}
    assert render.remapped([(0, 2)], "日本".encode("gb18030"), "gb18030") == [(0, 3)] and render.remapped([(2, 2)], b"abc", "utf-8") == []


def test_truncation_never_cuts_a_character(spark):
    rows = spark.createDataFrame([("añ日\U0001f600b",)], "line string")
    for n in range(13):
        r = rows.select(render.truncated(F.col("line"), n).alias("c")).first().c
        data = "añ日\U0001f600b".encode()
        assert r.truncated == (len(data) > n) and r.text.removesuffix("…").encode() == data[:n].decode("utf-8", "ignore").encode()


def test_config_round_trips():
    f = [Filter("a <&> \"q\"", enabled=True, regex=True, fore=0xFF00AA, mode="field", bold=True, font_size=12, group="g", scope="currentfile", extra=(("other", "1"),)), Filter("b", excluding=True)]
    c = config.Config(f, True, "2020-12-17", [("x", "y")])
    data = config.write_xml(c)
    assert data.startswith(b"\xef\xbb\xbf<?xml") and b"\r\n" in data and config.read_xml(data) == c
    assert config.read_json(config.write_json(c)).filters == f
    assert config.read_json("{}").filters == [] and config.read_json('{"version":0,"filters":[{}]}').filters == [Filter()]
    old = config.read_xml(f'<{config.ROOT} version="1"><filters><filter text="t" viewer_mode="field"/></filters></{config.ROOT}>'.encode())
    assert not old.filters[0].enabled and old.filters[0].mode == "field"
    for bad in (b"<other/>", b"<", b""):
        with pytest.raises(config.ConfigError):
            config.read_xml(bad)


def brute_segments(matches, total, c):
    shown = sorted({x for m in matches if m < total for x in range(max(0, m - c), min(total, m + c + 1))})
    out = []
    for x in shown:
        if out and x <= out[-1][1]:
            out[-1][1] = x + 1
        else:
            out.append([x, x + 1])
    return [tuple(s) for s in out]


@pytest.mark.parametrize(("matches", "total", "c"), [([10, 20, 30], 40, 3), ([0, 1, 9], 10, 2), ([5, 10], 40, 2), ([4, 10], 40, 2), ([50], 10, 1)])
def test_context(spark, matches, total, c):
    m = spark.createDataFrame([(0, x) for x in matches], "source_id long, line_no long")
    got = views.segments(m, spark.createDataFrame([(0, total)], "source_id long, total long"), c).orderBy("start").collect()
    want = brute_segments(matches, total, c)
    assert [(r.start, r.end) for r in got] == want
    assert [r.gap_before for r in got] == [s - (want[i - 1][1] if i else 0) for i, (s, _) in enumerate(want)]


def test_merge_against_a_heap(spark):
    import heapq
    import random

    r = random.Random(5)
    sources = [[r.randrange(20) for _ in range(r.randrange(1, 25))] for _ in range(4)]
    heads = [(s[0], k, 0) for k, s in enumerate(sources)]
    heapq.heapify(heads)
    want = []
    while heads:
        _, k, i = heapq.heappop(heads)
        want.append((k, i))
        if i + 1 < len(sources[k]):
            heapq.heappush(heads, (sources[k][i + 1], k, i + 1))
    df = spark.createDataFrame([(k, i, t) for k, s in enumerate(sources) for i, t in enumerate(s)], "source_id long, line_no long, ts_ns long")
    got = views.merge_rows(df, step_ns=5).orderBy("row").collect()
    assert [(x.source_id, x.line_no) for x in got] == want and [x.row for x in got] == list(range(len(want)))


def test_navigation(spark):
    m = spark.createDataFrame([(0, 10), (0, 20), (1, 5)], "source_id long, line_no long")
    at = lambda *a, **k: tuple(views.around(m, *a, **k).first())
    assert at(0, 10) == (0, 20) and at(0, 20) == (1, 5) and at(1, 5) == (0, 10) and at(0, 10, forward=False) == (1, 5)
    assert {tuple(r) for r in views.toggled(m, spark.createDataFrame([(0, 10), (2, 2)], m.schema)).collect()} == {(0, 20), (1, 5), (2, 2)}


@pytest.mark.parametrize(("data", "want"), [(b"", []), (b"a\nb\nc", ["a", "b", "c"]), (b"a\nb\nc\n", ["a", "b", "c"]), (b"a\r\n\r\nb\r\r\n\r\n", ["a", "", "b\r", ""]), (b"a\rb\n", ["a\rb"])])
def test_lines(spark, tmp_path, data, want):
    (tmp_path / "x.log").write_bytes(data)
    got = lines.read(prepared(spark), f"file://{tmp_path}/x.log").orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in got] == list(enumerate(want))


def test_line_numbers_over_splits_and_cache(spark, tmp_path):
    want = [f"line {i} " + "x" * (i % 50) for i in range(20_000)]
    (tmp_path / "x.log").write_text("\n".join(want))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        log = lines.kept(prepared(spark), f"file://{tmp_path}/x.log", f"file://{tmp_path}/cache")
        assert [(r.line_no, r.line) for r in log.orderBy("line_no").collect()] == list(enumerate(want))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert numbers(lines.span(log, 5000, 3)) == [5000, 5001, 5002] and numbers(lines.suffix(log, 19_998)) == [19_998, 19_999]


def test_encodings(spark):
    assert detected("é".encode()) == ("UTF-8", 0) and detected(b"\xef\xbb\xbfa") == ("UTF-8", 3) and detected("日本".encode("gb18030")) == ("GB18030", 0) and detected("é".encode()[:1]) == ("UTF-8", 0)
    with pytest.raises(EncodingError):
        detected(b"\xff\xfea\0")
    assert named("gb") == "GB18030" and named("shift-jis") == "Shift_JIS"
    with pytest.raises(EncodingError):
        named("nothing")
    prepared(spark)
    for label, name in ENCODINGS.items():
        data = bytes(range(32, 127)) + b"\xe4\xd6"
        got = spark.createDataFrame([(data,)], "raw binary").select(decoded(F.col("raw"), label)).first()[0]
        assert got.startswith(data[:60].decode("ascii")), label
        if name == "x-user-defined":
            assert got.endswith("\uf7e4\uf7d6")
        elif name.startswith(("cp", "iso", "koi", "mac")):
            assert got == data.decode(name, "replace"), label


def test_extraction(spark):
    log = frame(spark, ["a=1 b=2", "none", "a=3"])
    t = extract.by_regex(log, r"a=(?P<a>\d)(?: b=(\d))?")
    assert t.columns == ["a", "group_2"] and [tuple(r)[2:] for r in t.records.orderBy("line_no").collect()] == [("1", "2"), ("3", "")]
    assert extract.by_regex(log, "(").error and extract.by_regex(log, "a=").columns == ["match"] and extract.extracted(log, "").columns == []
    j = extract.by_json(frame(spark, ['{"b": null, "a": 1.50}', "x", '{"c": {"z": 1, "y": [true]}}', "[1]"]))
    assert j.columns == ["a", "b", "c"] and [tuple(r)[2:] for r in j.records.orderBy("line_no").collect()] == [("1.5", "", ""), ("", "", '{"y":[true],"z":1}')]
    assert extract.document_lines(spark, '[{"a":1}, 2, {"b":2}]').count() == 2
    head, rows = sinks.csv_rows(t.records, {"a": 'x,"y"'})
    assert head == '"x,""y""",group_2' and rows.count() == 2
    with pytest.raises(ValueError):
        sinks.refuse_own("file:///a/b", ["/a/./b"])


def test_catalog_and_templates(spark):
    log = frame(spark, [f"03-04 05:06:0{i}.000  {i % 2}  5 {'DW'[i % 2]} Net: open port {i} now" for i in range(8)])
    found = catalog.values(log)
    got = [tuple(r) for r in catalog.suggest(found, "tag:ne | op", 5).collect()]
    assert ("msg", "open", "tag:ne | open", 2) in got
    assert [r.value for r in catalog.suggest(found, "level=", 5).collect()] == ["W", "D"]
    assert [r.value for r in catalog.suggest(found, "opn", 5).collect()] == ["open"]
    assert catalog.most_recent(["a", "b"], "b", 2) == ["b", "a"]
    t = templates.top(templates.clustered(templates.masked(log))).collect()
    assert [r.n for r in t] == [8] and "<*>" in t[0].template


def test_command_line(spark, tmp_path):
    path = tmp_path / "x.log"
    path.write_text("one\ntwo words\nthree\n")
    (tmp_path / "f.tat").write_bytes(config.write_xml(config.Config([Filter("t"), Filter("words", excluding=True)])))
    assert [json.loads(x) for x in cli.run(["query", str(path), "t", "--max-lines", "1", "--max-bytes", "3"], spark)] == [{"line": 2, "text": "two…", "truncated": True}]
    assert [json.loads(x)["line"] for x in cli.run(["filter", str(path), str(tmp_path / "f.tat")], spark)] == [3]
    assert [json.loads(x)["text"] for x in cli.run(["read", str(path), "--line", "0", "--count", "2"], spark)] == ["one", "two words"]
    assert json.loads(cli.run(["info", str(path)], spark)[0])["lines"] == 3
    assert json.loads(cli.run(["config", str(tmp_path / "f.tat")])[0])["filters"][1]["excluding"]
    assert any(json.loads(x)["value"] == "words" for x in cli.run(["suggest", str(path), "wo"], spark))


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    found = tail.matching(tail.segments(spark, f"file://{folder}"), "b or level>=V")
    query = tail.follow(found.select("line"), "followed", checkpoint=f"file://{tmp_path}/state")
    for k in range(3):
        (folder / f"part-{k}.log").write_text("".join(f"{c} {k}\n" for c in "abc"))
        query.processAllAvailable()
    tail.stopped(query)
    assert sorted(r.line for r in spark.table("followed").collect()) == ["b 0", "b 1", "b 2"]
    assert [r.line for r in tail.numbered(spark, f"file://{folder}").orderBy("line_no").collect()] == [f"{c} {k}" for k in range(3) for c in "abc"]


def test_capture(spark, tmp_path):
    assert capture.devices("List of devices attached\nabc\tdevice\nxyz unauthorized\n\nemu-1 device product:x\n") == ["abc", "emu-1"]
    assert capture.safe_name("a:b/c-1.x") == "a_b_c-1.x" and capture.stamp(0.5) == "19700101_000000_500"
    writer = capture.SegmentWriter(str(tmp_path / "log"), flush_s=0)
    for piece in (b"one\ntw", b"o\nthr", b"ee"):
        writer.write(piece)
    writer.close()
    assert [r.line for r in tail.numbered(spark, f"file://{tmp_path}/log").orderBy("line_no").collect()] == ["one", "two", "three"]


def test_edited_copy(spark, tmp_path):
    log = frame(spark, ["a", "b", "c"])
    sinks.write_edited(log, spark.createDataFrame([(0, 1, "B")], "source_id long, line_no long, edit string"), f"file://{tmp_path}/out")
    assert [r.line for r in tail.numbered(spark, f"file://{tmp_path}/out").orderBy("line_no").collect()] == ["a", "B", "c"]


def test_spans_of_all_lines(spark, sf):
    from loglens import queries
    from loglens.sources.tables import doc_lines

    want = set()
    for r in doc_lines(spark, sf).collect():
        data = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.line).encode()
        hits = sorted((a, i, len(k)) for i, k in enumerate((b"the", b"her", b"e ")) for a in range(len(data)) if data.startswith(k, a))
        at = 0
        for a, i, n in hits:
            if max(a, at) < a + n:
                want.add((r.source_id, r.line_no, i, max(a, at), a + n))
                at = a + n
    got = queries.queries()["flt08_spans"](spark, sf).collect()
    assert {(r.source_id, r.line_no, r["filter"], r.start, r.end) for r in got} == want and len(got) == len(want)
    assert any(r.line_no > 0 for r in got)


def test_files_that_grew_and_that_were_written_anew(spark, tmp_path):
    from loglens.sources import lines

    path = tmp_path / "a.log"
    path.write_bytes(b"head\n" + b"x" * 200_000 + b"\nend\n")
    head, tail, n = lines.ends(spark, str(path))
    assert lines.grown(spark, str(path), head, n, tail)
    path.write_bytes(path.read_bytes() + b"more\n")
    assert lines.grown(spark, str(path), head, n, tail)
    changed = bytearray(path.read_bytes())
    changed[n - 2] = 0x21
    path.write_bytes(changed)
    assert lines.grown(spark, str(path), head, n) and not lines.grown(spark, str(path), head, n, tail)
    path.write_bytes(b"head\n")
    assert not lines.grown(spark, str(path), head, n, tail)


def test_numbers_of_lines_in_several_blocks(spark):
    from loglens.sources import lines

    rows = [("f", 0, (3 << 33) + i, f"a{i}") for i in range(5)] + [("f", 64, (1 << 33) + 7 + i, f"b{i}") for i in range(4)] + [("g", 0, i, f"c{i}") for i in range(3)]
    got = {(r.file, r.line_no): r.line for r in lines.numbered(spark.createDataFrame(rows[::-1], "file string, block long, at long, line string")).collect()}
    assert got == {("f", i): f"a{i}" for i in range(5)} | {("f", 5 + i): f"b{i}" for i in range(4)} | {("g", i): f"c{i}" for i in range(3)}


def test_size_warnings():
    from loglens.operators import scan

    assert scan.size_warning(scan.MANY_MATCHES) is None and "200,000,001" in scan.size_warning(scan.MANY_MATCHES + 1)
    assert "merged" in scan.size_warning(0, scan.MANY_MERGED + 1)
