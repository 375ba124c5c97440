"""A tolerant HTML reader: token stream, tree with implied end tags, block texts."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[A-Za-z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their own end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    """address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table
    tbody td tfoot th thead tr ul""".split()
)
#: Start tags that end an open paragraph.
_ENDS_P = BLOCK - {"br", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}
#: A start tag on the left ends the open elements on the right, up to the listed container.
_SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr"}),
    "th": ({"td", "th"}, {"tr"}),
    "option": ({"option"}, {"select", "optgroup"}),
}


@dataclass(slots=True)
class Element:
    name: str
    attrs: str = ""
    children: list = field(default_factory=list)
    label: str = ""


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(source)}


def label_of(name: str, source: str) -> str:
    """Tag name with the classes, id and role that tell page regions apart (digits masked)."""
    if not source.strip():
        return name
    a = attributes(source)
    marks = [*sorted(a.get("class", "").lower().split()), *(f"#{a['id'].lower()}" for _ in "i" if a.get("id")), *(f"@{a['role'].lower()}" for _ in "r" if a.get("role"))]
    if a.get("itemprop"):
        marks.append(f"%{a['itemprop'].lower()}")
    return re.sub(r"\d+", "0", ".".join([name, *marks]))


def parse(source: str) -> Element:
    """Tree of a page; text children are strings with character references decoded."""
    root = Element("#root", label="#root")
    stack = [root]
    at, n = 0, len(source)
    while at < n:
        match = _TOKEN.search(source, at)
        end = match.start() if match else n
        if end > at:
            stack[-1].children.append(html.unescape(source[at:end]))
        if not match:
            break
        at = match.end()
        name = match["name"] or match["name2"]
        if not name:
            if match[0].startswith("<![CDATA["):
                stack[-1].children.append(match[0][9:].removesuffix("]]>"))
            continue
        name = name.lower()
        if match["close"] or match["close2"]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name == name:
                    del stack[depth:]
                    break
                # An end tag does not reach out of a region or table cell.
                if stack[depth].name in ("article", "td", "th", "body") and name not in BLOCK:
                    break
            continue
        if name in _ENDS_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name == "p":
                    del stack[depth:]
                    break
                if stack[depth].name in BLOCK:
                    break
        if name in _SIBLINGS:
            ended, within = _SIBLINGS[name]
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name in within:
                    break
                if stack[depth].name in ended:
                    del stack[depth:]
                    break
        attrs = match["attrs"] if match["name"] else match["attrs2"]
        element = Element(name, attrs, label=label_of(name, attrs))
        stack[-1].children.append(element)
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}[\s/>]|\Z", re.I).search(source, at)
            if close.start() > at:
                element.children.append(source[at : close.start()])
            stop = source.find(">", close.start())
            at = n if stop < 0 else stop + 1
        elif name not in VOID and not attrs.endswith("/"):
            stack.append(element)
    return root
