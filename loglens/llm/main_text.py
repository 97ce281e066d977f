"""Main text of web pages by gradient-boosted trees over DOM nodes.

Every block element and every run of text is a node with features: tag, attribute tokens of its own and of its
ancestors, depth, subtree text, link and tag density, and its place and share among its siblings. The trees give the
odds that a node's subtree holds article text. Decoding keeps whole paths: a node stays only with its ancestors, and
the set of nodes that stay has the greatest sum of log odds of all such sets, so no ancestor and descendant
contradict each other. The model is trained here, from a fixed seed, on pages that ``invented`` makes from many
layouts, in a second or two on the driver, and its few kilobytes are broadcast.

Character references are decoded, white space in a block becomes one space, blocks are joined by a line end. Null and
empty pages have an empty text; pages without tags are one run. Each row is read by itself, whatever its length, so
ties and repeated rows give a row each; an empty table gives none; other columns are not looked at.
"""

from __future__ import annotations

import random
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loglens.llm.boosting import Trees, fit
from loglens.llm.dom import Node, parse

GOOD = frozenset("article content main post entry story body text page prose blog news paragraph".split())
BAD = frozenset(
    "nav menu menubar navbar ad ads adv advert advertisement advertising banner sponsor sponsored promo promotion sidebar side aside footer foot header masthead head top comment comments reply replies respond disqus discussion cookie cookies consent notice "
    "alert gdpr privacy share social related recommended widget breadcrumb breadcrumbs newsletter subscribe signup login search form popup modal overlay legal copyright toolbar tags pagination pager hidden skip rating survey navigation complementary contentinfo dialog".split()
)
TAGS = ("#run", "p", "div", "article", "main", "section", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "table", "tr", "td", "h1", "h2", "h3", "figure", "figcaption", "blockquote", "pre", "body", "html", "button", "fieldset", "dl")
_TAG_AT = {t: i for i, t in enumerate(TAGS)}
_BAD_TAGS = frozenset(("nav", "header", "footer", "aside", "form", "button", "fieldset", "dialog", "menu"))
_GOOD_TAGS = frozenset(("article", "main"))
MARK = "\x02"


def nodes(root: Node) -> list[Node]:
    """All nodes but the root, parents first, in page order."""
    out, todo = [], list(reversed(root.children))
    while todo:
        n = todo.pop()
        out.append(n)
        todo.extend(reversed(n.children))
    return out


def features(found: list[Node]) -> np.ndarray:
    """A row of features for each node of one page."""
    index = {id(n): i for i, n in enumerate(found)}
    parent = [index.get(id(n.parent), -1) for n in found]
    size = len(found)
    text, links, runs, tags, paragraphs, words, stops = ([0] * size for _ in range(7))
    for i in range(size - 1, -1, -1):
        n = found[i]
        if n.tag == "#run":
            text[i], links[i], runs[i] = len(n.text), n.linked, 1
            words[i], stops[i] = n.text.count(" ") + 1, n.text.count(".") + n.text.count(",")
        else:
            tags[i] += 1
            paragraphs[i] += n.tag == "p"
        p = parent[i]
        if p >= 0:
            for v in (text, links, runs, tags, paragraphs, words, stops):
                v[p] += v[i]
    whole = max(1, sum(t for t, p in zip(text, parent, strict=True) if p < 0))
    depth, good_up, bad_up = [0] * size, [0] * size, [0] * size
    out = np.zeros((size, len(TAGS) + 27), np.float32)
    before, tags_of = 0, {}
    for i, n in enumerate(found):
        p = parent[i]
        good = sum(t in GOOD for t in n.tokens) + (n.tag in _GOOD_TAGS)
        bad = sum(t in BAD for t in n.tokens) + (n.tag in _BAD_TAGS)
        depth[i] = depth[p] + 1 if p >= 0 else 0
        good_up[i] = good + (good_up[p] if p >= 0 else 0)
        bad_up[i] = bad + (bad_up[p] if p >= 0 else 0)
        density = links[i] / max(1, text[i])
        row = out[i]
        if n.tag in _TAG_AT:
            row[_TAG_AT[n.tag]] = 1
        if p >= 0 and found[p].tag in _TAG_AT:
            row[len(TAGS)] = _TAG_AT[found[p].tag] + 1
        siblings = n.parent.children
        if (same := tags_of.get(id(n.parent))) is None:
            same = tags_of[id(n.parent)] = Counter(s.tag for s in siblings)
        up_text = text[p] if p >= 0 else whole
        row[len(TAGS) + 1 :] = (
            good, bad, good_up[i], bad_up[i], good_up[i] - bad_up[i], depth[i], text[i], text[i] / whole, text[i] / max(1, up_text),
            density, text[i] / (tags[i] + 1), runs[i], text[i] / max(1, runs[i]), words[i], stops[i] / max(1, words[i]), paragraphs[i],
            len(siblings), same[n.tag] / len(siblings), (links[p] / max(1, text[p])) if p >= 0 else 0.0, tags[i], before / whole,
            (text[p] / (tags[p] + 1)) if p >= 0 else 0.0, (paragraphs[p] if p >= 0 else 0), bad_up[p] if p >= 0 else 0, good_up[p] if p >= 0 else 0, len(found),
        )
        if n.tag == "#run":
            before += text[i]
    return out


def decode(found: list[Node], odds: list[float]) -> list[bool]:
    """The heaviest set of nodes that holds every member's ancestors."""
    index = {id(n): i for i, n in enumerate(found)}
    value = list(odds)
    for i in range(len(found) - 1, -1, -1):
        p = index.get(id(found[i].parent), -1)
        if p >= 0 and value[i] > 0:
            value[p] += value[i]
    keep = []
    for i, n in enumerate(found):
        p = index.get(id(n.parent), -1)
        keep.append(value[i] > 0 and (p < 0 or keep[p]))
    return keep


def invented(seed: int) -> str:
    """A page of one of many layouts; article text carries MARK at its start."""
    r = random.Random(seed)
    syllables = ["".join(r.choices("bcdfglmnprstv", k=r.randint(1, 2))) + r.choice("aeiou") for _ in range(40)]
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda a=4, b=20: words(a, b).capitalize() + r.choice(".,.!?")
    prose = lambda a=1, b=7: " ".join(sentence() for _ in range(r.randint(a, b)))
    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'
    listed = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 9))) + "</ul>"
    named = lambda tag, names, inner: f'<{tag} {r.choice(["class", "class", "id"])}="{r.choice(names)}">{inner}</{tag}>'

    def part(kind: str) -> str:
        plain = lambda: r.choice([prose(1, 3), sentence(2, 9), listed(), f"<p>{prose(1, 3)}</p>"])
        if kind == "nav":
            return r.choice([f"<nav>{listed()}</nav>", named("div", ["menu", "navbar", "nav top", "main-menu", "breadcrumbs"], listed()), f"<nav>{' '.join(link() for _ in range(5))}</nav>"])
        if kind == "header":
            return r.choice([f"<header>{link()} {sentence(2, 8)}</header>", named("div", ["header", "site-header", "masthead"], f"<h2>{words(1, 4)}</h2>{sentence(2, 6)}"), f"<header><h1>{words(1, 3)}</h1>{listed()}</header>"])
        if kind == "footer":
            return r.choice([f"<footer>&copy; {word()}.example &middot; {plain()}</footer>", named("div", ["footer", "site-footer", "copyright"], f"&copy; {plain()}"), f"<footer><p>{prose(1, 2)}</p>{listed()}</footer>"])
        if kind == "ad":
            return r.choice([named("div", ["ad", "ads", "advert", "ad-banner", "sponsored", "promo", "advertisement"], plain()), named("aside", ["ad", "sponsor"], plain()), f'<div class="ad">{prose(1, 3)}</div>'])
        if kind == "side":
            return r.choice([f"<aside>{plain()}</aside>", named("div", ["sidebar", "widget", "related", "social-share", "newsletter"], f"<h3>{words(1, 3)}</h3>{plain()}"), named("section", ["related", "recommended"], listed())])
        if kind == "notice":
            return named("div", ["cookie-notice", "cookie", "notice", "alert", "gdpr-consent", "banner"], r.choice([prose(1, 3), f"<p>{prose(1, 3)}</p><button>OK</button>"]))
        if kind == "comments":
            one = lambda: r.choice([f"<p>{prose(1, 4)}</p>", named("div", ["comment", "comment-body", "reply"], f"<b>{word()}</b> <p>{prose(1, 4)}</p>"), f"<li>{prose(1, 4)}</li>"])
            return r.choice([named("div", ["comments", "comment-list", "discussion", "responses comments"], f"<h3>{words(1, 2)}</h3>" + "".join(one() for _ in range(r.randint(1, 6)))), named("section", ["comments"], "".join(one() for _ in range(r.randint(1, 6))))])
        return r.choice([f'<form action="/s"><label>{words(1, 3)}</label><input name="q"><button>{word()}</button></form>', named("form", ["login", "search", "subscribe"], f"<p>{sentence()}</p><input><button>{word()}</button>"), f"<form>{prose(1, 2)}</form>"])

    def block() -> str:
        x = r.random()
        body = MARK + (prose(1, 9) if r.random() < 0.8 else sentence(1, 5))
        if x < 0.62:
            return f"<p>{body}</p>" if r.random() < 0.85 else f"<p><b>{body}<br>"
        if x < 0.7:
            return f"<h{(k := r.randint(1, 3))}>{MARK}{words(1, 8)}</h{k}>"
        if x < 0.76:
            return "<ul>" + "".join(f"<li>{MARK}{sentence()}" + r.choice(["", "</li>"]) for _ in range(r.randint(1, 5))) + "</ul>"
        if x < 0.81:
            return f"<blockquote>{body}</blockquote>"
        if x < 0.85:
            return f"<p>{body} {link()} {sentence()}</p>"
        if x < 0.88:
            return f"<table><tr><td>{MARK}{words(1, 5)}</td><td>{MARK}{words(1, 5)}</td></tr></table>"
        if x < 0.91:
            return f"<pre>{body}</pre>"
        if x < 0.95:
            return f"<div>{body}</div>"
        return f"<figure><img src='x'><figcaption>{MARK}{sentence()}</figcaption></figure>"

    outer = ["nav", "header", "footer", "ad", "side", "notice", "comments", "form"]
    blocks = [f"<h1>{MARK}{words(1, 12)}</h1>"] * (r.random() < 0.8) + [block() for _ in range(r.choice([1, 1, 2, 3, 5, 8, 13]))]
    for kind in r.choices(["ad", "side", "form", "notice"], k=r.choice([0, 0, 0, 1, 2])):
        blocks.insert(r.randint(0, len(blocks)), part(kind))
    if r.random() < 0.25:
        blocks.append(part("comments"))
    inside = "".join(blocks)
    if r.random() < 0.05:
        article = f"<div>{inside}</div>"
    else:
        article = r.choice([f"<article>{inside}</article>", f"<article>{inside}</article>", f"<main>{inside}</main>", f"<main><article>{inside}</article></main>", named("div", ["content", "post", "entry-content", "article-body", "main", "story"], inside), f'<div class="wrapper"><section class="post">{inside}</section></div>'])
    first = "".join(part(k) for k in r.sample(outer[:6] + ["form"], r.randint(0, 4)) if k not in ("footer", "comments"))
    last = "".join(part(k) for k in r.sample(outer, r.randint(0, 4)))
    page = f"{first}{article}{last}"
    if r.random() < 0.4:
        page = f'<div class="{r.choice(["container", "wrap", "page", "layout"])}">{page}</div>'
    head = f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><style>p{{}}</style></head><body>"
    return (head if r.random() < 0.9 else "") + page + ("</body></html>" if r.random() < 0.8 else "")


@lru_cache(maxsize=2)
def model(pages: int = 400) -> Trees:
    """The trees, from invented pages."""
    rows, target = [], []
    for seed in range(pages):
        found = nodes(parse(invented(seed)))
        good = [MARK in n.text for n in found]
        index = {id(n): i for i, n in enumerate(found)}
        for i in range(len(found) - 1, -1, -1):
            found[i].text = found[i].text.replace(MARK, "")
            p = index.get(id(found[i].parent), -1)
            if good[i] and p >= 0:
                good[p] = True
        rows.append(features(found))
        target += good
    return fit(np.concatenate(rows), np.array(target, float))


def blocks(found: list[Node], odds: np.ndarray) -> list[str]:
    return [n.text for n, keep in zip(found, decode(found, odds.tolist()), strict=True) if keep and n.tag == "#run"]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, ``text`` and ``n_chars``."""
    held = pages.sparkSession.sparkContext.broadcast(model())
    kinds = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id_col, url_col)]

    def texts(part: list[list[Node]]) -> list[str]:
        rows = [features(found) for found in part]
        odds = held.value.odds(np.concatenate(rows)) if rows else np.zeros(0)
        ends = np.cumsum([len(x) for x in rows])
        return ["\n".join(blocks(found, odds[e - len(x) : e])) for found, x, e in zip(part, rows, ends, strict=True)]

    def run(batches):
        for batch in batches:
            start, part, size = 0, [], 0
            for i, x in enumerate(batch.column(2)):
                page = x.as_py() or ""
                part.append(nodes(parse(page)))
                size += len(page)
                if size > 1 << 20 or i == batch.num_rows - 1:
                    out = texts(part)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(out)), batch.column(1).slice(start, len(out)), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=[id_col, url_col, "text", "n_chars"])
                    start, part, size = i + 1, [], 0

    return pages.select(id_col, url_col, html_col).mapInArrow(run, ", ".join([*kinds, "text string", "n_chars long"]))
