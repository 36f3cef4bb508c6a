"""A tolerant HTML tree, a subset of CSS selectors, and Markdown, in plain Python.

The tree knows void elements, raw text, implied ends of ``p``, ``li``, table parts and options, and
closes what is left open. Selectors: type, ``#id``, ``.class``, ``[attr]``, ``[attr=value]``, ``:not()``,
descendants and commas.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
P_ENDS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SCOPES = frozenset("table ul ol div section article body html td th".split())
BLOCKS = P_ENDS | {"li", "tr", "body", "dd", "dt", "thead", "tbody"}


class Node:
    """An element; its children are nodes and strings."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs=(), parent: Node | None = None):
        self.tag, self.parent = tag, parent
        self.attrs = {}
        for k, v in attrs:
            self.attrs.setdefault(k, v or "")
        self.children: list[Node | str] = []

    def walk(self):
        """Elements below, in document order."""
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def remove(self) -> None:
        self.replace(None)

    def replace(self, other: Node | str | None) -> None:
        if self.parent is None:
            return
        at = next((i for i, c in enumerate(self.parent.children) if c is self), None)
        if at is not None:
            self.parent.children[at : at + 1] = [] if other is None else [other]
        self.parent = None


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.open = [self.root]

    def _close(self, tags, until=SCOPES):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in until:
                return

    def handle_starttag(self, tag, attrs):
        if tag in P_ENDS:
            self._close({"p"})
        if tag in CLOSES:
            self._close(CLOSES[tag], {"ul", "ol", "dl", "table", "select"})
        node = Node(tag, attrs, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


_SIMPLE = re.compile(r"(?P<type>\*|[\w-]+)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<attr>[\w-]+)(?:=[\"']?(?P<value>[^\"'\]]*)[\"']?)?\]|:not\((?P<no>[^()]*)\)")


def _compound(text: str):
    tests, at = [], 0
    while at < len(text):
        m = _SIMPLE.match(text, at)
        if not m:
            raise ValueError(f"selector not supported: {text!r}")
        at = m.end()
        if m["type"]:
            if m["type"] != "*":
                tests.append(lambda n, v=m["type"].lower(): n.tag == v)
        elif m["id"]:
            tests.append(lambda n, v=m["id"]: n.attrs.get("id") == v)
        elif m["cls"]:
            tests.append(lambda n, v=m["cls"]: v in n.attrs.get("class", "").split())
        elif m["attr"]:
            tests.append(lambda n, k=m["attr"].lower(), v=m["value"]: k in n.attrs and (v is None or n.attrs[k] == v))
        else:
            inner = _compound(m["no"].strip())
            tests.append(lambda n, f=inner: not f(n))
    return lambda n: all(t(n) for t in tests)


def selector(text: str):
    """A test of elements."""
    chains = [[_compound(c) for c in part.split()] for part in text.split(",") if part.strip()]

    def fits(node: Node, chain) -> bool:
        if not chain[-1](node):
            return False
        rest, up = chain[:-1], node.parent
        while rest and up is not None:
            if rest[-1](up):
                rest = rest[:-1]
            up = up.parent
        return not rest

    return lambda node: any(fits(node, c) for c in chains)


def select(root: Node, text: str) -> list[Node]:
    test = selector(text)
    return [n for n in root.walk() if test(n)]


def escape(text: str, quote: bool = False) -> str:
    text = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return text.replace('"', "&quot;") if quote else text


def outer(node: Node | str) -> str:
    if isinstance(node, str):
        return escape(node)
    attrs = "".join(f' {k}="{escape(v, True)}"' for k, v in node.attrs.items())
    start = f"<{node.tag}{attrs}>"
    return start if node.tag in VOID else start + "".join(map(outer, node.children)) + f"</{node.tag}>"


def _inline(node: Node | str) -> str:
    if isinstance(node, str):
        return re.sub(r"\s+", " ", node)
    inner = "".join(map(_inline, node.children))
    tag = node.tag
    if tag == "br":
        return "  \n"
    if tag == "img":
        return f"![{node.attrs.get('alt', '')}]({node.attrs.get('src', '')})"
    if tag == "a":
        return f"[{inner.strip()}]({node.attrs['href']})" if "href" in node.attrs else inner
    if tag in ("b", "strong") and inner.strip():
        return f"**{inner.strip()}**"
    if tag in ("i", "em") and inner.strip():
        return f"*{inner.strip()}*"
    if tag in ("s", "del", "strike") and inner.strip():
        return f"~~{inner.strip()}~~"
    if tag == "code":
        return f"`{inner}`"
    if tag in ("iframe", "script", "style"):
        return outer(node) if tag == "iframe" else ""
    return inner


def _blocks(node: Node, indent: str = "") -> list[str]:
    out: list[str] = []
    line: list[Node | str] = []

    def flush():
        text = re.sub(r" *\n *", "\n", re.sub(r"[ \t]+", " ", "".join(map(_inline, line)))).strip(" \n") if not any(isinstance(x, Node) and x.tag == "br" for x in line) else "".join(map(_inline, line)).strip()
        if text:
            out.append(text)
        line.clear()

    for c in node.children:
        if isinstance(c, str) or not (c.tag in BLOCKS or c.tag in ("script", "style") or any(d.tag in BLOCKS for d in c.walk())):
            line.append(c)
            continue
        flush()
        tag = c.tag
        if re.fullmatch("h[1-6]", tag):
            if text := "".join(map(_inline, c.children)).strip():
                out.append("#" * int(tag[1]) + " " + text)
        elif tag in ("ul", "ol"):
            items = []
            for i, li in enumerate(x for x in c.children if isinstance(x, Node) and x.tag == "li"):
                mark = "- " if tag == "ul" else f"{i + 1}. "
                body = _blocks(li)
                items.append(mark + "\n".join(body).replace("\n", "\n" + " " * len(mark)) if body else mark.rstrip())
            if items:
                out.append("\n".join(items))
        elif tag == "blockquote":
            if body := "\n\n".join(_blocks(c)):
                out.append("\n".join(("> " + x).rstrip() for x in body.split("\n")))
        elif tag == "pre":
            out.append("```\n" + c.text().strip("\n") + "\n```")
        elif tag == "hr":
            out.append("* * *")
        elif tag == "table":
            rows = [[" ".join(_blocks(x)).replace("\n", " ") for x in r.children if isinstance(x, Node) and x.tag in ("td", "th")] for r in c.walk() if r.tag == "tr"]
            if rows := [r for r in rows if r]:
                width = max(map(len, rows))
                lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
                out.append("\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]))
        elif tag not in ("script", "style"):
            out += _blocks(c)
    flush()
    return out


def to_markdown(nodes: list[Node]) -> str:
    root = Node("#document")
    root.children = list(nodes)
    return "\n\n".join(_blocks(root))


_EMPTY_LINK = re.compile(r"(?<!!)\[\]\([^)]*\)")
_EMPTY_ITEM = re.compile(r"\s*(\d+\.|[-*+])\s*")


def tidy(markdown: str) -> str:
    """Without links that show nothing and list items that hold nothing."""
    lines = (x.rstrip() for x in _EMPTY_LINK.sub("", markdown).split("\n"))
    return "\n".join(x for x in lines if not _EMPTY_ITEM.fullmatch(x)).strip()
