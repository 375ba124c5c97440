"""Wrapper inference: union-free regular expressions over same-host token streams.

A wrapper is a list of nodes.  ``["e", label, pages, repeated, children]`` is an
element, ``["t", constants, chars, pages]`` text, whose ``constants`` are hashes of
the texts that every page has there (a slot has none), and ``["g", pages, nodes]``
a repeated group of several nodes.  ``pages`` counts the pages that have the node;
one with fewer than the node around it is optional.  A page becomes such a list
by folding tandem repeats; two lists are aligned by a longest common subsequence
of their keys: matched nodes are merged, unmatched ones become optional, texts
that differ become slots.  Alternatives (unions) never arise.

Sizes are bounded: elements below ``DEPTH`` levels count as text of the last one,
and of a wrapper over ``MAX_NODES`` nodes those seen on the fewest pages go.
Repeated groups have up to ``PERIOD`` nodes.
"""

from __future__ import annotations

import bisect
from collections import Counter

import xxhash

from marlstone.llm.htmltree import RAW, Element

DEPTH = 60
MAX_NODES = 3000
#: Nodes of the longest repeated group.
PERIOD = 200


def text_hash(text: str) -> str:
    return xxhash.xxh3_64_hexdigest(text)[:12]


def step(path: str, label: str) -> str:
    """Name of the path one label below another path; as long for deep paths as for short ones."""
    return text_hash(f"{path}>{label}")


def _key(node: list) -> str:
    if node[0] == "e":
        return node[1]
    if node[0] == "t":
        return "#text"
    return "(" + " ".join(_key(x) for x in node[2]) + ")+"


def pages_of(node: list) -> int:
    return node[3] if node[0] == "t" else node[2] if node[0] == "e" else node[1]


def _merge(a: list, b: list, across: bool) -> list:
    """Two nodes of equal key, of different pages or of one."""
    pages = pages_of(a) + pages_of(b) if across else max(pages_of(a), pages_of(b))
    if a[0] == "t":
        shared = set(a[1]) & set(b[1]) if across else set(a[1]) | set(b[1])
        return ["t", sorted(shared), a[2] + b[2], pages]
    if a[0] == "g":
        return ["g", pages, align(a[2], b[2], across)]
    return ["e", a[1], pages, a[3] or b[3], align(a[4], b[4], across)]


def _matches(ka: list[str], kb: list[str]) -> list[tuple[int, int]]:
    """Longest common subsequence of keys as index pairs: the longest chain of matches that grow in both lists."""
    places: dict[str, list[int]] = {}
    for j, k in enumerate(kb):
        places.setdefault(k, []).append(j)
    ends: list[int] = []  # of the best chain of each length, its last index in kb
    heads: list[tuple[int, int, object]] = []
    for i, k in enumerate(ka):
        for j in reversed(places.get(k, ())):
            at = bisect.bisect_left(ends, j)
            link = (i, j, heads[at - 1] if at else None)
            if at == len(ends):
                ends.append(j)
                heads.append(link)
            else:
                ends[at], heads[at] = j, link
    out, link = [], heads[-1] if heads else None
    while link:
        out.append(link[:2])
        link = link[2]
    return out[::-1]


def align(a: list[list], b: list[list], across: bool = True) -> list[list]:
    """Generalise two node lists to one that matches what either matches."""
    ka, kb = [_key(x) for x in a], [_key(x) for x in b]
    if ka == kb:
        return [_merge(x, y, across) for x, y in zip(a, b)]
    out, i, j = [], 0, 0
    for x, y in [*_matches(ka, kb), (len(a), len(b))]:
        out += a[i:x] + b[j:y]
        if x < len(a) and y < len(b):
            out.append(_merge(a[x], b[y], across))
        i, j = x + 1, y + 1
    return fold(out)


def fold(nodes: list[list]) -> list[list]:
    """Fold tandem repeats: equal neighbours into one repeated node, longer squares into groups."""
    out: list[list] = []
    keys: list[str] = []

    def put(node: list, size: int) -> None:
        out[len(out) - size :] = [node]
        keys[len(keys) - size :] = [_key(node)]

    for node in nodes:
        if keys and keys[-1] == _key(node):
            node = _merge(out[-1], node, False)
            if node[0] == "e":
                node[3] = True
            put(node, 1)
        else:
            put(node, 0)
        while _squared(out, keys, put):
            pass
    return out


def _squared(out: list[list], keys: list[str], put) -> bool:
    """Fold a square, or one more turn of a group, at the end of the list."""
    n = len(keys)
    for period in range(2, min(n, PERIOD + 1)):
        group = out[n - period - 1]
        if group[0] == "g" and len(group[2]) == period and [_key(x) for x in group[2]] == keys[n - period :]:
            put(["g", group[1], [_merge(x, y, False) for x, y in zip(group[2], out[n - period :])]], period + 1)
            return True
        if 2 * period > n or keys[n - 1] != keys[n - 1 - period] or keys[n - 2] != keys[n - 2 - period] or keys[n - period :] != keys[n - 2 * period : n - period]:
            continue
        turn = [_merge(x, y, False) for x, y in zip(out[n - 2 * period : n - period], out[n - period :])]
        if any(x[0] == "e" for x in turn):
            put(["g", max(map(pages_of, turn)), turn], 2 * period)
            return True
    return False


def of_page(root: Element) -> list[list]:
    """Folded node list of an element's children, for any depth of nesting."""
    done: list[list] = []
    stack: list[tuple[Element, int, list]] = [(root, 0, done)]
    order = []
    while stack:  # elements outside in; their children's lists are folded inside out below
        element, depth, nodes = stack.pop()
        order.append(nodes)
        for child in element.children:
            if isinstance(child, str):
                text = " ".join(child.split())
                if text:
                    nodes.append(["t", [text_hash(text)], len(text), 1])
            elif depth >= DEPTH:
                text = " ".join(" ".join(strings(child)).split())
                if text:
                    nodes.append(["t", [text_hash(text)], len(text), 1])
            else:
                node = ["e", child.label, 1, False, []]
                nodes.append(node)
                if child.name not in RAW:
                    stack.append((child, depth + 1, node[4]))
    for nodes in reversed(order):
        nodes[:] = fold(nodes)
    return done


def strings(root: Element):
    """All texts below an element in page order, but for those of raw elements."""
    stack = [iter(root.children)]
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
        elif isinstance(child, str):
            yield child
        elif child.name not in RAW:
            stack.append(iter(child.children))


def _children(node: list) -> list[list]:
    return node[4] if node[0] == "e" else node[2] if node[0] == "g" else []


def bounded(nodes: list[list], most: int = MAX_NODES) -> list[list]:
    """The wrapper without the nodes that are on the fewest pages, if it has more than ``most``; of equals the first stay."""
    counts: Counter[int] = Counter()

    def count(list_: list[list], limit: int) -> None:
        for node in list_:
            # A node goes with the one around it.
            counts[min(limit, pages_of(node))] += 1
            count(_children(node), min(limit, pages_of(node)))

    def cut(list_: list[list], least: int) -> list[list]:
        nonlocal room
        kept = []
        for node in list_:
            if room and pages_of(node) >= least:
                room -= 1
                _children(node)[:] = cut(_children(node), least)
                kept.append(node)
        return kept

    count(nodes, 1 << 62)
    room, over, least = most, sum(counts.values()) - most, 0
    if over <= 0:
        return nodes
    for least in sorted(counts):
        if over <= 0:
            break
        over -= counts[least]
    return cut(nodes, least)


def walk(nodes: list[list], pages: int, part: float, path: str = ""):
    """(path, element or text node) of a wrapper, outside in; groups are looked through and texts have their element's path.

    Nodes on fewer than ``part`` of the pages that have the node around them are
    left out with all that is in them.
    """
    for node in nodes:
        if pages_of(node) < part * pages:
            continue
        if node[0] == "g":
            yield from walk(node[2], node[1], part, path)
        elif node[0] == "t":
            yield path, node
        else:
            here = step(path, node[1])
            yield here, node
            yield from walk(node[4], node[2], part, here)
