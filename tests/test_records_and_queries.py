import random

import pytest

from loglens.functions import text
from loglens.functions.records import with_record
from loglens.functions.regexes import PatternError, translated
from loglens.functions.times import civil_days, time_value
from loglens.operators import scan
from loglens.plans.query import Options, QueryError, compiled
from loglens.plans.searchbox import expanded, time_range

LINES = [
    "03-04 05:06:07.678  1234  5678 D Alpha: magic starts here",
    "03-04 05:06:08.000  1234  9999 W Beta: slow reply",
    "03-04 05:06:09.500  4321  5678 E Alpha: magic failed",
    "a plain line with magic",
    "2024-02-31 23:59:60.1234567891  1  2 i Tag:sub: x: y",
    "03-04 05:06:07.678 E/Legacy  ( 77): old form",
    "13-04 05:06:07.678  1234  5678 D Bad: month",
    "03-04 05:06:07:000000005  4294967297  5 S Wrap:",
    "03-04 05:06:07.678  12 D Short: no thread id",
    "03-04 05:06:07.678  1  2 Dxx T: no level",
    "03-04 05:06:07.678  1  2 F T\x01ag: odd \x01 bytes",
    "",
]
DAY = 86_400 * 10**9


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([(0, i, x) for i, x in enumerate(LINES)], "source_id long, line_no long, line string")


def found(lines, source, **options):
    return sorted(r.line_no for r in scan.by_query(lines, source, Options(**options)).lines.select("line_no").collect())


def test_records(lines):
    got = {r.line_no: r for r in with_record(lines).collect()}
    base = civil_days(1970, 3, 4) * DAY + (5 * 3600 + 6 * 60 + 7) * 10**9
    assert (got[0].ts_ns, got[0].pid, got[0].tid, got[0].level, got[0].tag, got[0].msg) == (base + 678 * 10**6, 1234, 5678, 1, "Alpha", "magic starts here")
    assert (got[4].ts_ns, got[4].level, got[4].tag, got[4].msg) == (civil_days(2024, 3, 2) * DAY + DAY + 123456789, 2, "Tag:sub", "x: y")
    assert (got[5].pid, got[5].tid, got[5].level, got[5].tag, got[5].msg) == (77, None, 4, "Legacy", "old form")
    assert (got[7].ts_ns, got[7].pid, got[7].tag, got[7].msg) == (base + 5, 1, "Wrap", "")
    assert (got[10].tag, got[10].msg) == ("T\x01ag", "odd \x01 bytes")
    for i in (3, 6, 8, 9, 11):
        assert not got[i].structured and got[i].msg == LINES[i] and got[i].tag == "" and got[i].ts_ns is None


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("", list(range(12))), ("MAGIC", [0, 2, 3]), ("magic and not failed", [0, 3]), ("magic failed or slow", [1, 2]), ("level>=W", [1, 2, 5, 7, 10]), ("not level>=W", [0, 3, 4, 6, 8, 9, 11]),
        ("tag=alpha", []), ("tag=Alpha", [0, 2]), ("tag:alpha", [0, 2]), ("tag!=Alpha and not is:log", [3, 6, 8, 9, 11]), ("level!=D", [1, 2, 4, 5, 7, 10]), ("is!=log pid=1234", [0, 1]),
        ("time>=05:06:08", [0, 1, 2, 4, 5, 7, 10]), ("/MAGIC (starts|failed)/", [0, 2]), ("msg~fail$", []), ("msg~failed$", [2]), ("tag>/al/", [0, 2]), ("msg~/failed/i", [2]), ("'a plain'", [3]), ("! magic & slow", [1]), ("(slow | failed) pid=1234", [1]), ("tid = 5", [7]),
    ],
)
def test_queries(lines, source, want):
    assert found(lines, source) == want


def test_query_options(lines):
    assert found(lines, "MAGIC", case_sensitive=True) == []
    assert found(lines, "time>=05:06:08 and level>=V", base=civil_days(1970, 3, 4) * DAY) == [1, 2, 4]
    assert found(lines, "magc", fuzzy=True) == [0, 2, 3] and found(lines, "strats", fuzzy=True) == [0]


@pytest.mark.parametrize("source", ['"open', "(a", "a)", "/re", "level>=", "level>=loud", "pid=x", "nope=1", "time<nonsense", "and", "is:other", "level~E", "tag>x", "/(/", "/(?=a)/", r"/(a)\1/", "a or"])
def test_query_errors(spark, source):
    with pytest.raises(QueryError):
        compiled(source)


def test_too_many_conditions(spark):
    with pytest.raises(QueryError):
        compiled(" or ".join(["a"] * 257))
    compiled(" or ".join(["a"] * 256))


def test_random_queries_against_python(lines):
    r = random.Random(4)
    words = ["magic", "slow", "a", "05", "E", "plain"]

    def made(depth):
        if depth == 0 or r.random() < 0.3:
            w = r.choice(words)
            return f'"{w}"', lambda x: w.lower() in x.lower()
        kind = r.choice(["and", "or", "not"])
        a, fa = made(depth - 1)
        if kind == "not":
            return f"not ({a})", lambda x: not fa(x)
        b, fb = made(depth - 1)
        return f"({a}) {kind} ({b})", (lambda x: fa(x) and fb(x)) if kind == "and" else (lambda x: fa(x) or fb(x))

    for _ in range(12):
        source, model = made(3)
        assert found(lines, source) == [i for i, x in enumerate(LINES) if model(x)]


def test_searchbox():
    assert expanded("a b | c & tag:x") == (["a b", "c"], '"a b" or ("c" and tag:x)')
    assert expanded("level>=W") == (["level>=W"], '"level>=W"')
    assert expanded('say "hi"') == (['say "hi"'], '"say \\"hi\\""')
    assert time_range("t:01-02 03:04:05") == 'time>="01-02 03:04:05"'
    assert time_range("t:03:04 05:06") == '(time>="03:04" and time<="05:06")'
    assert time_range("t:x") is None and time_range("tag:x") is None


def test_times():
    assert time_value("1970-01-02 00:00:00") == DAY and time_value("1:2", base=5 * DAY + 7) == 5 * DAY + 3_720 * 10**9
    assert time_value("01-02 00:00:01:5", base=civil_days(2024, 5, 5) * DAY) == civil_days(2024, 1, 2) * DAY + 15 * 10**8
    for bad in ("24:00", "01-02 03:10", "13-01 00:00:00", "1:2:3.0000000001", "x", "1:2:3.4:5"):
        assert time_value(bad) is None


def test_patterns():
    assert translated("(?P<a_b>x)(y)(?:z)")[1] == ["a_b", None]
    assert translated("a$")[0].endswith("a\\z") and translated("[$]")[0].endswith("[$]")
    for bad in ("(?=a)", "(?<!a)", r"(a)\1", "(", "[a", "a++"):
        with pytest.raises(PatternError):
            translated(bad)


def test_small_functions():
    assert text.fragment('tag:"a|b" | le') == ('tag:"a|b" | ', "le") and text.fragment("x") == ("", "x")
    assert text.completion("a.b-c_1") == "a.b-c_1" and text.completion('a "b"') == '"a \\"b\\""'
    assert text.line_range("1-100") == (0, 100) and text.line_range("5-") is None and text.line_range("9-3") is None
    assert text.color("#ff0000") == 0xFF0000 and text.color("red") is None and text.flag("True") and not text.flag("n")
    assert text.fnv1a64(b"") == 0xCBF29CE484222325 and text.fnv1a64(b"a") == 0xAF63DC4C8601EC8C
