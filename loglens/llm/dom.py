"""A tolerant HTML reader: a tree of block elements whose leaves are runs of inline text."""

from __future__ import annotations

import html as entities
import re

INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
SKIPPED = frozenset("script style noscript template textarea title iframe xmp svg math object select option canvas audio video map".split())
#: Elements that a start tag of these closes while open, down to the elements that hold them.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_TOKENS = re.compile(r"""(?:^|[\s"'])(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""display\s*:\s*none|(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true""", re.I)
_PARTS = re.compile(r"[a-z]+")


class Node:
    """A block element, or a run of text (tag ``#run``)."""

    __slots__ = ("tag", "tokens", "parent", "children", "text", "linked", "bold")

    def __init__(self, tag: str, parent: Node | None, tokens: tuple[str, ...] = ()):
        self.tag, self.parent, self.tokens = tag, parent, tokens
        self.children: list[Node] = []
        self.text, self.linked = "", 0
        if parent is not None:
            parent.children.append(self)


def attribute_tokens(attributes: str) -> tuple[str, ...]:
    if not attributes:
        return ()
    found = [t for m in _TOKENS.finditer(attributes) for t in _PARTS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", m[1] or m[2] or m[3] or "").lower())]
    return (*found, "hidden") if _HIDDEN.search(attributes) else tuple(found)


def parse(page: str) -> Node:
    """The tree of a page. What is in SKIPPED elements, comments and declarations is left out; unclosed and stray tags are borne."""
    root = here = Node("#root", None)
    run: list[str] = []
    linked, links, at = 0, 0, 0

    def flush() -> None:
        nonlocal run, linked
        text = " ".join(entities.unescape("".join(run)).split()) if run else ""
        if text:
            leaf = Node("#run", here)
            leaf.text, leaf.linked = text, min(linked, len(text))
        run, linked = [], 0

    while True:
        m = _TAG.search(page, at)
        piece = page[at : m.start() if m else len(page)]
        if piece:
            run.append(piece)
            if links:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing = bool(m[1] or m[4])
        if name in SKIPPED:
            if not closing and not (m[3] or m[6] or "").endswith("/"):
                end = re.compile(f"</{re.escape(name)}[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in INLINE:
            if name == "a":
                links = 0 if closing else 1
            elif name in ("br", "img"):
                run.append(" ")
            continue
        flush()
        links = 0
        if closing:
            node = here
            while node is not root and node.tag != name:
                node = node.parent
            if node is not root:
                here = node.parent
            continue
        close, within = CLOSES.get(name, ({"p"}, set()))
        node = here
        while node is not root and node.tag not in within and node.tag not in close and (name in CLOSES or node.tag == "p"):
            node = node.parent
        if node.tag in close:
            here = node.parent
        node = Node(name, here, attribute_tokens(m[3] or m[6] or ""))
        if name not in VOID and not (m[3] or m[6] or "").endswith("/"):
            here = node
    flush()
    return root
