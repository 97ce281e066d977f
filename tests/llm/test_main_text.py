import numpy as np
import pytest

from loglens.llm import boosting, main_text, queries
from loglens.llm.common import table
from loglens.llm.dom import parse


def texts(page):
    found = main_text.nodes(parse(page))
    return main_text.blocks(found, main_text.model().odds(main_text.features(found))) if found else []


def test_invented_pages_that_were_not_learnt():
    wrong = 0
    for seed in range(5_000, 5_150):
        page = main_text.invented(seed)
        want = [n.text.replace(main_text.MARK, "") for n in main_text.nodes(parse(page)) if main_text.MARK in n.text]
        wrong += texts(page.replace(main_text.MARK, "")) != want
    assert wrong <= 3


def test_reader():
    run = lambda page: [n.text for n in main_text.nodes(parse(page)) if n.tag == "#run"]
    assert run("<p>a &amp; b<br>c<p>d <b>e</b>\n\n f<!-- x --><script>if (a < b) '</p>'</script> g</div>h") == ["a & b c", "d e f g", "h"]
    assert run("") == [] and run("a < b") == ["a < b"] and run("<ul><li>x<li>y<ul><li>z</ul></ul>w") == ["x", "y", "z", "w"]
    assert run('<p title="a > b">t</p><p title="open>u</p>') == ["t", "u"]
    assert run("<div " * 2000) == []


@pytest.mark.parametrize("seed", range(20))
def test_decoding_is_the_heaviest_closed_set(seed):
    r = np.random.default_rng(seed)
    root = main_text.Node("#root", None)
    every = [root]
    for _ in range(9):
        every.append(main_text.Node("p", every[int(r.integers(len(every)))]))
    found = main_text.nodes(root)
    odds = r.normal(size=len(found)).tolist()
    keep = main_text.decode(found, odds)
    place = {id(n): i for i, n in enumerate(found)}
    closed = lambda bits: all(not bits[i] or n.parent is root or bits[place[id(n.parent)]] for i, n in enumerate(found))
    weight = lambda bits: sum(o for o, b in zip(odds, bits, strict=True) if b)
    assert closed(keep)
    best = max(weight(bits) for k in range(2 ** len(found)) if closed(bits := [k >> i & 1 for i in range(len(found))]))
    assert abs(weight(keep) - best) < 1e-9


def test_boosting_learns_an_interaction():
    r = np.random.default_rng(3)
    x = r.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    trees = boosting.fit(x[:2000], y[:2000], trees=30, depth=3)
    assert np.mean((trees.odds(x[2000:]) > 0) == (y[2000:] == 1)) > 0.95


def test_edges(spark):
    page = "<nav><ul><li><a href='/'>menu</a></li></ul></nav><article><h1>Head&nbsp;line</h1><p>" + "word and word. " * 20 + "</p></article><footer>&copy; end</footer>"
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", page, "x"), (4, "u", page, "x"), (4, "u", page, None), (5, "u", "<article>" + "<p>long text of it, and more.</p>" * 20_000 + "</article>", "x")]
    got = main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 6
    by = {r.page_id: r for r in got}
    assert by[1].text == by[2].text == "" and by[2].n_chars == 0
    assert by[4].text == by[None].text == "Head line\n" + ("word and word. " * 20).strip()
    assert by[5].n_chars == len(by[5].text) and by[5].text.count("\n") == 19_999
    assert main_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_query(spark, sf):
    got = {r.page_id: r for r in queries.op4_main_text(spark, sf).collect()}
    for r in table(spark, sf, "pages").collect():
        inside = r.html[r.html.index("<article>") : r.html.index("</article>")]
        want = [n.text for n in main_text.nodes(parse(inside)) if n.tag == "#run"]
        assert got[r.page_id].text == "\n".join(want) and got[r.page_id].url == r.url
