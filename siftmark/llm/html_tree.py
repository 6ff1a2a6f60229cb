"""A tolerant block tree of an HTML page.

Only what block structure needs: elements that lay out as blocks become nodes; inline elements
fold into the text of their block; each run of text between block tags is a leaf of its parent.
Controls and embedded objects (buttons, selections, drawings, films) are nodes of their own if they
are closed; the content of an unclosed one belongs to the element around it. Raw-text elements,
comments and declarations are skipped; an unclosed script or style hides the rest of a page, as in a
browser, of other unclosed raw elements only the tag is skipped. Tags that end tags imply are closed
as HTML prescribes for paragraphs, list items and table parts. Depth is not limited, and the time
is linear in the page.
"""

from __future__ import annotations

import html
import re
from collections import Counter

#: Element names by role, from the HTML standard.
BLOCKS = frozenset(
    "html body article section main header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption"
    " blockquote pre figure figcaption form fieldset legend details summary dialog address center hgroup search menu".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDING = frozenset(("script", "style"))
RAW = HIDING | frozenset("noscript iframe textarea title head".split())
CONTROLS = frozenset("button select object canvas audio video svg template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag of the key closes an open element of the values, within the nearest of its scope.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tbody", "thead"}, "tbody": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}}
TABLE = {"table"}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)")
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|aria-label|hidden|style)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPACE = re.compile(r"\s+")
END = {name: re.compile(f"</{name}(?![^\\s/>])[^>]*(?:>|\\Z)", re.I) for name in RAW}
EITHER = {name: re.compile(f"<(/?){name}(?![^\\s/>])", re.I) for name in CONTROLS}
BODY = re.compile(r"<body\b", re.I)


class Ahead:
    """Next matches of patterns in a page, asked for from rising places; each part of the page is searched once by a pattern."""

    def __init__(self, page: str):
        self.page, self.found = page, {}

    def next(self, pattern: re.Pattern, here: int) -> re.Match | None:
        if pattern not in self.found or (m := self.found[pattern]) is not None and m.start() < here:
            self.found[pattern] = pattern.search(self.page, here)
        return self.found[pattern]


class Node:
    """An element, or a run of text (``tag`` is "#text")."""

    __slots__ = ("attributes", "children", "depth", "link_chars", "parent", "tag", "text")

    def __init__(self, tag: str, parent: Node | None, attributes: str = "", text: str = ""):
        self.tag, self.parent, self.attributes, self.text = tag, parent, attributes, text
        self.children: list[Node] = []
        self.depth = parent.depth + 1 if parent else 0
        self.link_chars = 0


def attribute_tokens(source: str) -> str:
    """Values of the attributes that say what an element is for, lower-cased."""
    return " ".join(next((v for v in m[1:] if v), "") for m in ATTRIBUTE.findall(source)).lower() if source and "=" in source else ""


def parse(page: str | None) -> Node:
    """The root of a page's block tree; null and empty pages have a root without children."""
    root = Node("html", None)
    page = page or ""
    ahead, opened = Ahead(page), Counter()
    at, here = root, 0
    parts: list[str] = []
    links = depth_in_links = 0

    def enter(name: str, attributes: str) -> None:
        nonlocal at
        child = Node(name, at, attribute_tokens(attributes))
        at.children.append(child)
        opened[name] += 1
        at = child

    def leave(node: Node) -> None:
        """Go up to ``node``."""
        nonlocal at
        while at is not node:
            opened[at.tag] -= 1
            at = at.parent

    def close(name: str) -> None:
        """End the nearest open element of a name, if there is one."""
        if opened[name] > 0:
            node = at
            while node.tag != name:
                node = node.parent
            leave(node.parent)

    def flush() -> None:
        nonlocal links
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                leaf = Node("#text", at, "", text)
                leaf.link_chars = min(links, len(text))
                at.children.append(leaf)
            parts.clear()
        links = 0

    def add(raw: str) -> None:
        nonlocal links
        if raw:
            parts.append(raw)
            if depth_in_links:
                links += len(raw.strip())

    size = len(page)
    while here < size:
        start = page.find("<", here)
        if start < 0:
            add(page[here:])
            break
        add(page[here:start])
        m = TAG.match(page, start) or LOOSE.match(page, start)
        if m is None:
            add("<")
            here = start + 1
            continue
        here = m.end()
        if m.lastindex is None:  # a comment or a declaration
            continue
        closing, name, attributes = m[1], m[2].lower(), m[3]
        if name in RAW:
            if not closing and not attributes.endswith("/"):
                end = ahead.next(END[name], here)
                if name == "head":
                    body = ahead.next(BODY, here)
                    here = min([x for x in (end and end.end(), body and body.start()) if x is not None], default=here)
                elif end or name in HIDING:
                    here = end.end() if end else size
                parts.append(" ")
            continue
        if name == "a":
            depth_in_links = 0 if closing else 1
            continue
        if name in ("br", "hr"):
            parts.append(" ")
            continue
        if name in CONTROLS:
            parts.append(" ")
            if closing:
                if opened[name] > 0:
                    flush()
                    close(name)
            elif not attributes.endswith("/") and (m := ahead.next(EITHER[name], here)) and m[1]:
                flush()
                enter(name, attributes)
            continue
        if name not in BLOCKS:
            if name in ("img", "input"):
                parts.append(" ")
            continue
        flush()
        depth_in_links = 0
        if name in ("html", "body"):
            if not closing and name == "body" and at is root:
                enter("body", attributes)
            continue
        if closing:
            close(name)
            continue
        # a block starts: an open paragraph or heading ends
        node = at
        while node.tag == "p" or node.tag in HEADINGS and name in HEADINGS:
            node = node.parent
        leave(node)
        if name in CLOSES and any(opened[x] > 0 for x in CLOSES[name]):
            stop = SCOPES.get(name, TABLE)
            while node is not None and node.tag not in stop and node.tag not in CLOSES[name]:
                node = node.parent
            if node is not None and node.tag in CLOSES[name]:
                while node.tag in CLOSES[name] and node.parent is not None:
                    node = node.parent
                leave(node)
        if attributes.endswith("/"):
            at.children.append(Node(name, at, attribute_tokens(attributes)))
        else:
            enter(name, attributes)
    flush()
    return root
