"""A forgiving HTML reader: block elements and the text runs between their borders."""

from __future__ import annotations

import html
import re

_TOKEN = re.compile(
    r"<!---?>|<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<",
    re.S,
)
_NAMES = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

# How elements nest.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr del"
    " math mi mo mn ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mspace mstyle semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea template iframe svg title".split())
#: Of RAW, those that are ordinary elements if no closing tag follows.
CONTAINERS = frozenset("svg template".split())
IMPLIED = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
    "option": {"option"}, "thead": {"p"}, "tbody": {"thead", "tr", "td", "th", "p"}, "tfoot": {"tbody", "tr", "td", "th", "p"},
}
SCOPES = frozenset("ul ol dl table body html div section article aside nav main header footer form".split())


class Node:
    """An element, or a text run (tag ``#text``)."""

    __slots__ = ("tag", "names", "parent", "depth", "text", "linked")

    def __init__(self, tag: str, names: str, parent: int, depth: int, text: str = "", linked: int = 0):
        self.tag, self.names, self.parent, self.depth, self.text, self.linked = tag, names, parent, depth, text, linked


def _names(attributes: str) -> str:
    if not attributes or attributes.isspace():
        return ""
    found = []
    for name, value in _NAMES.findall(attributes):
        name = name.lower()
        if name in ("hidden", "aria-hidden"):
            if value.strip("\"'").lower() != "false":
                found.append("hidden")
        elif name == "style":
            if _UNSEEN.search(value):
                found.append("hidden")
        else:
            found.append(value.strip("\"'").lower())
    return " ".join(found)


def parse(page: str | None) -> list[Node]:
    """Nodes in page order, the root first. Scripts, styles, comments and other raw elements leave no node.

    Text is decoded, its white space is one space, and it is trimmed; empty runs leave no node. ``linked``
    counts the characters of a run inside links.
    """
    nodes = [Node("#root", "", -1, 0)]
    stack = [0]
    pieces: list[tuple[str, bool]] = []
    links = 0

    def flush() -> None:
        nonlocal links
        if pieces:
            text = " ".join(html.unescape("".join(p for p, _ in pieces)).split())
            if text:
                linked = sum(len(p) for p, in_link in pieces if in_link)
                top = stack[-1]
                nodes.append(Node("#text", "", top, nodes[top].depth + 1, text, min(linked, len(text))))
            pieces.clear()

    page = page or ""
    lowered = None
    unclosed: set[str] = set()
    count: dict[str, int] = {}  # open elements by tag

    def pop_to(k: int) -> None:
        for i in stack[k:]:
            count[nodes[i].tag] -= 1
        del stack[k:]

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            token = m[0]
            if token[:2] not in ("<!", "<?"):
                pieces.append((token, links > 0))
            continue
        tag = tag.lower()
        closing = bool(m[1] or m[4])
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            continue
        if tag == "br":
            pieces.append((" ", links > 0))
            continue
        if closing:
            if tag == "head":
                continue
            if tag not in RAW or count.get(tag):
                flush()
            if count.get(tag):
                links = 0
                pop_to(next(k for k in range(len(stack) - 1, 0, -1) if nodes[stack[k]].tag == tag))
            continue
        if tag in RAW:
            if m[0].endswith("/>") and tag in ("svg", "iframe", "template"):
                continue
            if lowered is None:
                lowered = page.lower()
                if len(lowered) != n:  # a few letters change length
                    lowered = "".join(c if len(c.lower()) != 1 else c.lower() for c in page)
            end = -1 if tag in unclosed else lowered.find(f"</{tag}", at)
            if end >= 0:
                close = page.find(">", end)
                at = n if close < 0 else close + 1
                continue
            unclosed.add(tag)
            if tag not in CONTAINERS:
                at = n
                continue
        flush()
        if tag in VOID or tag in ("html", "head"):
            continue
        if tag == "body":
            if count.get("body"):
                continue
        closes = IMPLIED.get(tag, set()) | {"p"}
        while len(stack) > 1 and nodes[stack[-1]].tag in closes:
            pop_to(len(stack) - 1)
        if tag in IMPLIED:
            for k in range(len(stack) - 1, 0, -1):
                own = nodes[stack[k]].tag
                if own in IMPLIED[tag]:
                    pop_to(k)
                    break
                if own in SCOPES:
                    break
        top = stack[-1]
        nodes.append(Node(tag, _names(m[3] or m[6] or ""), top, nodes[top].depth + 1))
        stack.append(len(nodes) - 1)
        count[tag] = count.get(tag, 0) + 1
    flush()
    return nodes
