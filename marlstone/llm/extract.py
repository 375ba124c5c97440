"""Main text of web pages by wrappers inferred for each host.

1. Every page is folded into a wrapper; pages of one host that fold alike count
   once.  Wrappers of a host are aligned in groups of ``GROUP_PAGES`` and then,
   ``FAN`` at a time, with each other.  Groups are dealt and ordered by the
   wrappers' hashes, so that the result does not depend on partitions, and a host
   with a third of all pages is many small groups.
2. A host's plan holds what its wrapper tells apart from slots: the texts that
   pages share, by their paths.
3. Pages are read by their host's plan.  The region is the page's articles (or
   main elements) if these hold enough of its varying text outside links, else
   the deepest element with most of it.  In the region, menus, headers, footers,
   asides, forms, adverts, notices and comments are left out by their element,
   by attributes that hide or name them, and by the plan: shared texts go.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from marlstone.llm import wrapper as W
from marlstone.llm.htmltree import BLOCK, Element, attributes, parse
from marlstone.llm.words import utf8_rows
from marlstone.plans.scratch import Scratch

# Elements of page furniture, words that name it, and words that only go with those.
FURNITURE_TAGS = frozenset(
    """head script style template noscript nav header footer aside form button select textarea input label fieldset menu
    dialog iframe object embed svg canvas audio video map title link meta xmp noembed noframes""".split()
)
FURNITURE_WORDS = frozenset(
    """ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos promotion promotions
    banner banners cookie cookies consent gdpr notice notices alert popup popups modal overlay menu menus nav navbar navigation sidebar
    sidebars footer header masthead topbar toolbar breadcrumb breadcrumbs comment comments commentlist respond reply replies disqus share
    sharing social related recommended recommendations newsletter subscribe subscription signup login search pagination pager widget widgets
    skip copyright complementary contentinfo""".split()
)
COMPANIONS = frozenset(
    """area bar bars block blocks body bottom box btn button buttons by container count cta float fixed form global group holder icon icons
    in inline inner item items l left link links list lists main media more out outer page panel policy post posts articles r right row section
    site slot small sticky strip sub tab tabs thread title to top unit up wrap wrapper""".split()
)
REGION_NAMES = frozenset("articlebody article-body article-content post-content post-body entry-content story-body main-content".split())
#: Pages to a group of the first alignment, and wrappers to a group of the following ones.
GROUP_PAGES, FAN = 200, 16
#: Distinct pages that have to have a text for it to be shared furniture, and their share of the pages with the element around it
#: (and of that one's of the pages around it, and so on): a host may have several templates.
SHARED_PAGES, SHARED_PART = 4, 0.2
#: Plans of a host are broadcast up to so many bytes in all.
BROADCAST_PLANS = 8_000_000
#: Varying text that articles have to hold for their tag to decide, and that a region found by its text has to hold.
ARTICLE_PART, REGION_PART = 0.1, 0.8
#: Shared texts of a region beyond this part of it are no furniture (the pages are copies of each other).
COPY_PART = 0.5
_INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd mark p pre q s samp small span strike strong sub sup tt u var h1 h2 h3 h4 h5 h6".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _names_furniture(word: str) -> bool:
    """Whether a class, id or role is made of words for furniture alone, such as ``cookie-notice`` or ``comment-list``."""
    parts = [p for p in re.split(r"[-_:]+", re.sub(r"\d+", "", word.lower())) if p]
    return any(p in FURNITURE_WORDS for p in parts) and all(p in FURNITURE_WORDS or p in COMPANIONS for p in parts)


def is_furniture(element: Element) -> bool:
    """By element, or by attributes (outside html, body, article and main): hidden, or named as furniture."""
    if element.name in FURNITURE_TAGS:
        return True
    if element.name in ("html", "body", "article", "main") or not element.attrs.strip():
        return False
    a = attributes(element.attrs)
    if a.get("hidden", "false").lower() != "false" or a.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(a.get("style", "")):
        return True
    return any(map(_names_furniture, [*a.get("class", "").split(), a.get("id", ""), a.get("role", "")]))


def _names_region(element: Element) -> bool:
    if not element.attrs.strip():
        return False
    a = attributes(element.attrs)
    return any(x.lower() in REGION_NAMES for x in (*a.get("class", "").split(), a.get("id", ""), a.get("itemprop", "")))


def plan_of(nodes: list[list], pages: int) -> dict:
    """``{"pages": ..., "shared": {path: text hashes}}``: the texts that all pages with their element have in the same place."""
    shared: dict[str, set[str]] = {}
    for path, node in W.walk(nodes, pages, SHARED_PART):
        if node[0] == "t" and node[1] and node[3] >= SHARED_PAGES:
            shared.setdefault(path, set()).update(node[1])
    return {"pages": pages, "shared": {p: sorted(x) for p, x in sorted(shared.items())}}


class _Page:
    """A page's elements outside in, with the characters of varying, shared and linked text below each."""

    def __init__(self, root: Element, shared: dict[str, list[str]]):
        self.shared = {p: frozenset(x) for p, x in shared.items()}
        self.elements, self.parent, self.path, self.own, self.skipped, linked = [root], [-1], [""], [False], [False], [False]
        i = 0
        while i < len(self.elements):
            for child in self.elements[i].children:
                if isinstance(child, Element):
                    self.elements.append(child)
                    self.parent.append(i)
                    self.path.append(W.step(self.path[i], child.label) if self.shared else "")
                    self.own.append(is_furniture(child))
                    self.skipped.append(self.skipped[i] or self.own[-1])
                    linked.append(linked[i] or child.name == "a")
            i += 1
        self.index = {id(e): k for k, e in enumerate(self.elements)}
        n = len(self.elements)
        self.varying, self.same, self.links = [0] * n, [0] * n, [0] * n
        for k in range(n - 1, -1, -1):
            if not self.skipped[k]:
                for child in self.elements[k].children:
                    if isinstance(child, str) and (text := " ".join(child.split())):
                        kind = self.same if self.is_shared(k, text) else self.links if linked[k] else self.varying
                        kind[k] += len(text)
            if k:
                for kind in (self.varying, self.same, self.links):
                    kind[self.parent[k]] += kind[k]

    def is_shared(self, k: int, text: str) -> bool:
        known = self.shared.get(self.path[k])
        return known is not None and W.text_hash(text) in known

    def outermost(self, wanted, skip) -> list[int]:
        """Elements that are wanted and not inside another wanted or skipped one, in page order."""
        found, stack = [], [0]
        while stack:
            k = stack.pop()
            e = self.elements[k]
            if k and skip(k):
                continue
            if k and wanted(e):
                found.append(k)
            else:
                stack += [self.index[id(c)] for c in reversed(e.children) if isinstance(c, Element)]
        return found

    def regions(self) -> list[int]:
        """Elements that hold the main text: by name if they have enough varying text, else by their text."""
        total, some = self.varying[0], False
        for name in ("article", "main"):
            found = self.outermost(lambda e: e.name == name, lambda k: self.skipped[k])  # noqa: B023
            some = some or bool(found)
            if found and sum(self.varying[k] + self.same[k] for k in found) >= ARTICLE_PART * total:
                return found
        for name in () if some else ("article", "main"):  # inside something that is named as furniture
            found = self.outermost(lambda e: e.name == name, lambda k: self.elements[k].name in FURNITURE_TAGS)  # noqa: B023
            if found:
                return found
        found = self.outermost(_names_region, lambda k: self.skipped[k])
        if found and sum(self.varying[k] for k in found) >= REGION_PART / 2 * total:
            return found
        k = 0
        while total:
            held = [self.index[id(c)] for c in self.elements[k].children if isinstance(c, Element)]
            best = next((c for c in held if self.elements[c].name not in _INLINE and self.varying[c] >= REGION_PART * total), None)
            if best is None:
                break
            k = best
        return [k]

    def is_menu(self, k: int) -> bool:
        """A block of links: most of its text stands in three or more of them."""
        e = self.elements[k]
        if e.name in _INLINE or 4 * self.links[k] < 3 * (self.links[k] + self.varying[k] + self.same[k]):
            return False
        return sum(1 for name in _names_below(e) if name == "a") >= 3

    def text(self, regions: list[int]) -> str:
        """Blocks of the regions in page order, without furniture, shared texts and, where no tag names the region, menus."""
        named = all(self.elements[k].name in ("article", "main") for k in regions)
        whole = sum(self.varying[k] + self.same[k] + self.links[k] for k in regions)
        drop = 0 < sum(self.same[k] for k in regions) <= COPY_PART * whole
        blocks: list[list[tuple[str, bool]]] = [[]]  # strings, and whether they are shared
        for region in regions:
            blocks.append([])
            stack: list[tuple[int, Iterator, bool]] = [(region, iter(self.elements[region].children), False)]
            while stack:
                k, children, block = stack[-1]
                child = next(children, None)
                if child is None:
                    stack.pop()
                    if block:
                        blocks.append([])
                elif isinstance(child, str):
                    blocks[-1].append((child, drop and self.is_shared(k, " ".join(child.split()))))
                else:
                    at = self.index[id(child)]
                    if not self.own[at] and (named or not self.is_menu(at)):
                        if child.name in BLOCK:
                            blocks.append([])
                        stack.append((at, iter(child.children), child.name in BLOCK))
        texts = (" ".join("".join(x for x, _ in b).split()) for b in blocks if not all(same or not x.strip() for x, same in b))
        return " ".join(t for t in texts if t)


def _names_below(element: Element) -> Iterator[str]:
    stack = [element]
    while stack:
        for child in stack.pop().children:
            if isinstance(child, Element):
                yield child.name
                stack.append(child)


def main_text(source: str, plan: dict) -> str:
    """Main text of a page by its host's plan; '' if there is none."""
    page = _Page(parse(source), plan.get("shared", {}))
    if page.same[0] and not page.varying[0]:  # nothing varies: the host's pages are copies of each other
        page = _Page(page.elements[0], {})
    return page.text(page.regions())


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1))


FOLDED = "host string, digest long, wrapper string"
GROUPED = "host string, part long, pages long, wrapper string"


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, digests, wrappers = [], [], []
        for host, source in zip(batch.column(0).to_pylist(), utf8_rows(batch.column(1))):
            if source:
                hosts.append(host)
                wrappers.append(_dump(W.of_page(parse(source.decode()))))
                digests.append(xxhash.xxh3_64_intdigest(wrappers[-1]) >> 1)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(digests, pa.int64()), pa.array(wrappers, pa.string())], ["host", "digest", "wrapper"])


def _dump(nodes: list) -> str:
    return json.dumps(nodes, separators=(",", ":"))


def _aligned(table: pa.Table) -> tuple[int, list]:
    """Pages and wrapper of a group, aligned in the order of the wrappers' texts."""
    rows = sorted(zip(table["wrapper"].to_pylist(), table["pages"].to_pylist()))
    nodes, pages = W.bounded(json.loads(rows[0][0])), rows[0][1]
    for text, n in rows[1:]:
        nodes, pages = W.bounded(W.align(nodes, json.loads(text))), pages + n
    return pages, nodes


def _combine(table: pa.Table) -> pa.Table:
    pages, nodes = _aligned(table)
    return pa.table({"host": table["host"][:1], "part": table["part"][:1], "pages": [pages], "wrapper": [_dump(nodes)]})


def _planned(table: pa.Table) -> pa.Table:
    pages, nodes = _aligned(table)
    return pa.table({"host": table["host"][:1], "pages": [pages], "plan": [json.dumps(plan_of(nodes, pages))], "wrapper": [_dump(nodes)]})


def infer_wrappers(pages: DataFrame, *, group: int = GROUP_PAGES) -> DataFrame:
    """(host, pages, plan, wrapper): one row per host of ``pages`` (url, html).

    ``pages`` counts pages that fold differently.  The result is the same for
    any partitioning of the input.
    """
    scratch = Scratch(pages.sparkSession, "wrappers")
    rows = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_folded, FOLDED)
    folded = scratch.table(rows.distinct(), "folded")
    sizes = scratch.table(folded.groupBy("host").agg(F.ceil(F.count("*") / group).alias("parts")), "sizes")
    most = sizes.agg(F.max("parts")).first()[0] or 0
    parts = folded.join(sizes, "host").select("host", F.pmod("digest", "parts").alias("part"), F.lit(1).cast("long").alias("pages"), "wrapper")
    while most > 1:
        parts = parts.groupBy("host", "part").applyInArrow(_combine, GROUPED).withColumn("part", F.floor(F.col("part") / FAN))
        most = -(-most // FAN)
    return parts.groupBy("host").applyInArrow(_planned, "host string, pages long, plan string, wrapper string")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    plans: dict[str | None, dict] = {}
    for batch in batches:
        texts = []
        for source, plan in zip(utf8_rows(batch.column(2)), batch.column(3).to_pylist()):
            if plan not in plans:
                if len(plans) > 1000:
                    plans.clear()
                plans[plan] = json.loads(plan) if plan else {}
            texts.append(main_text(source.decode(), plans[plan]) if source else "")
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per input row.

    ``text`` is the main text with character references decoded, white space
    inside a block turned into one space, and blocks joined in page order by a
    space; '' if there is none.  Null and empty html give ''.  A null or
    hostless url belongs to the host ''.  Ids may repeat or be null; other
    columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(pages.sparkSession, "extract")
    plans = scratch.table(infer_wrappers(pages).select("host", "plan"), "plans")
    size = plans.agg(F.sum(F.length("host") + F.length("plan"))).first()[0] or 0
    if size <= BROADCAST_PLANS:
        plans = F.broadcast(plans)
    read = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(plans, "host", "left")
    return read.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "plan").mapInArrow(
        _apply, "page_id long, url string, text string, n_chars long"
    )
