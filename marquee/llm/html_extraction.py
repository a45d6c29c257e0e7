"""Main text of web pages by wrapper induction.

Pages of a host share templates. For each host and page layout (the outline of the body) one page,
the shortest, serves as a skeleton: whatever all pages of a layout show is in the shortest too.
Every page of the host is aligned with a skeleton by simple tree matching. A text of the skeleton
that nine tenths of the pages repeat, at least EVIDENCE of them, is template; all other texts are
slots. The main text of a page consists of its slots inside the article, in page order, without
page furniture, which is known by its element, role or class: menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and comments of readers vary too and yet are no content.
A page that repeats nearly all of its skeleton's text is a copy of it and tells nothing about what
is template, so groups of copies don't turn an article into template.

Counts of equal texts come from all pages; nothing is sampled. A hot host is no group of its own:
its pages meet the skeletons by a join that Spark broadcasts or splits, and only counts per
skeleton node leave a task.

A null html is empty and gives an empty text; so does a page without text. A page without a host,
or of a layout with few pages, is cut by elements, roles and classes alone. Repeated pages are
copies as above; repeated and null page ids are pages of their own. An empty table gives an empty
result. Only the three named columns are read, so others can't clash.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marquee.llm.dom import BLOCK, HEADINGS, RAW, TEXT, Node, align, outline, parse, walk
from marquee.plans.lineage import materialize

# Skeletons per host, the most frequent layouts first; pages of rarer ones meet the first skeleton.
LAYOUTS = 8
# A text is template if this share of at least so many different pages repeat it.
CONSTANT = 0.9
EVIDENCE = 8
# A page with more than this share of its skeleton's characters is its copy.
COPY = 0.8
# Shortest pages that a task holds before it hands them on.
HELD_BYTES = 32 << 20

# Elements, roles and class or id words of page furniture.
FURNITURE = frozenset(
    "aside button canvas dialog embed footer form header iframe input label map menu nav noembed"
    " noframes noscript object script search select style svg template textarea title video audio"
    " datalist optgroup option".split()
)
ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation"
    " search status toolbar".split()
)
WORDS = frozenset(
    "ad ads adsbygoogle advert advertisement advertising adverts alert announcement aside banner"
    " breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus"
    " footer footnav form gdpr header login masthead menu message modal nav navbar navigation"
    " newsletter notice notices notification pager pagination popup promo promoted promotion"
    " recommended related replies reply respond responses search share sharing sidebar signin"
    " signup skip social sponsor sponsored subscribe subscription teaser toolbar topbar topnav"
    " widget widgets".split()
)
COMMENT_WORDS = frozenset("comment comments disqus replies reply respond responses".split())
# Elements that classes never make furniture: words inside a sentence.
INLINE = frozenset("b body code em html i main mark small strong sub sup u".split()) | HEADINGS
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)

OUTPUT = "page_id bigint, url string, text string, n_chars bigint"


def host(url: Column) -> Column:
    """Host of a URL, in lower case; empty where there is none."""
    found = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(F.coalesce(found, F.lit("")))


def _words(node: Node, attributes: dict[str, str]) -> set[str]:
    named = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    return set(SPLIT.split(CAMEL.sub(" ", named).lower()))


def _is_furniture(node: Node) -> str:
    """Why a node is furniture: by its element, by a mark such as its class, or not ('')."""
    if node.tag in FURNITURE:
        return "element"
    if not node.raw:
        return ""
    attributes = node.attributes()
    if node.tag not in ("html", "body"):
        if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
            return "element"
        if HIDDEN.search(attributes.get("style", "")):
            return "element"
    if attributes.get("role", "").lower() in ROLES and node.tag not in ("html", "body"):
        return "mark"
    if node.tag in INLINE:
        return ""
    words = _words(node, attributes)
    if words & COMMENT_WORDS:
        return "comment"
    return "mark" if words & WORDS and node.tag != "article" else ""


class Page:
    """A parsed page with its furniture marked."""

    def __init__(self, html: str):
        self.root = parse(html)
        self.nodes = list(walk(self.root))
        self.size = [0] * len(self.nodes)  # characters of text, without furniture
        self.linked = [0] * len(self.nodes)  # of these, inside links
        self.out = [False] * len(self.nodes)
        self.article: Node | None = None

    def judge(self, template: set[int]) -> None:
        """Mark furniture and template texts, and find the article."""
        why = [_is_furniture(n) if n.tag != TEXT else "" for n in self.nodes]
        holds = [False] * len(self.nodes)  # an article or a main heading
        mains: list[Node] = []
        for node in reversed(self.nodes):
            if node.tag in ("article", "main", "h1"):
                holds[node.at] = holds[node.at] or why[node.at] != "comment"
            if holds[node.at] and node.up is not None:
                holds[node.up.at] = True
        for node in self.nodes:
            up = node.up
            marked = why[node.at]
            if marked == "mark" and holds[node.at]:
                marked = ""  # a wrapper that only names what else it holds
            if node.tag == "header" and up is not None and self._within(node, "article"):
                marked = ""  # the heading of the article itself
            self.out[node.at] = bool(marked) or (up is not None and self.out[up.at])
            if node.tag == TEXT and node.at in template:
                self.out[node.at] = True
        for node in reversed(self.nodes):
            if node.tag == TEXT and not self.out[node.at]:
                self.size[node.at] = len(node.text.strip())
            if node.tag == "a":
                self.linked[node.at] = self.size[node.at]
            if node.up is not None:
                self.size[node.up.at] += self.size[node.at]
                self.linked[node.up.at] += self.linked[node.at]
        for node in self.nodes:
            if not self.out[node.at] and self._is_main(node):
                mains.append(node)
        articles = [n for n in mains if n.tag != "main" and n.attributes().get("role") != "main"]
        inner = articles or mains
        if inner:
            self.article = max(inner, key=lambda n: (self.size[n.at], -n.at))
        else:
            self.article = self._descend()

    @staticmethod
    def _within(node: Node, tag: str) -> bool:
        up = node.up
        while up is not None:
            if up.tag == tag:
                return True
            up = up.up
        return False

    @staticmethod
    def _is_main(node: Node) -> bool:
        if node.tag in ("article", "main"):
            return True
        if "role" not in node.raw and "itemprop" not in node.raw:
            return False
        attributes = node.attributes()
        return (
            attributes.get("role", "").lower() in ("main", "article")
            or attributes.get("itemprop", "").lower() == "articlebody"
        )

    def _descend(self) -> Node:
        """Without a marked article: the lowest element with most of the text that is no links."""
        node = self.root

        def prose(n: Node) -> int:
            return self.size[n.at] - self.linked[n.at]

        while True:
            wide = [k for k in node.kids if k.tag in BLOCK and k.tag != "p" and not self.out[k.at]]
            heavy = [k for k in wide if prose(k) >= 0.8 * prose(node) and prose(k) > 0]
            if not heavy or heavy[0].tag in HEADINGS | {"li", "tr", "td", "pre", "blockquote"}:
                return node
            node = heavy[0]

    def text(self) -> str:
        """Blocks of the article, one a line, with references decoded and white space joined."""
        blocks: list[str] = []
        current: list[str] = []
        marked = self.article is not None and self._is_main(self.article)

        def flush() -> None:
            if current:
                line = " ".join(entities.unescape("".join(current)).split())
                current.clear()
                if line:
                    blocks.append(line)

        todo: list[Node | None] = [self.article]
        while todo:
            node = todo.pop()
            if node is None:
                flush()
                continue
            if self.out[node.at] or node.tag in RAW:
                continue
            if node.tag == TEXT:
                current.append(node.text)
                continue
            if node.tag == "br":
                current.append(" ")
                continue
            if not marked and self._is_link_list(node):
                continue
            if node.tag in BLOCK:
                flush()
                todo.append(None)
            todo.extend(reversed(node.kids))
        flush()
        return "\n".join(blocks)

    def _is_link_list(self, node: Node) -> bool:
        if node.tag not in ("ul", "ol", "div", "section", "table") or node is self.article:
            return False
        links = sum(1 for n in walk(node) if n.tag == "a")
        return links >= 3 and self.linked[node.at] > 0.7 * self.size[node.at]


class Skeleton:
    """One layout's shortest page, and the texts of it that are template."""

    def __init__(self, layout: str, html: str, constant: frozenset[int] = frozenset()):
        self.layout, self.page, self.constant = layout, Page(html), constant
        self.texts = {n.at: n.text.strip() for n in self.page.nodes if n.tag == TEXT}
        self.characters = sum(map(len, self.texts.values()))

    def compare(self, page: Page) -> tuple[list[int], dict[int, int], bool]:
        """(texts that are the same, their places in the page, is the page a copy)."""
        places = {
            own.at: other.at
            for own, other in align(self.page.root, page.root)
            if self.texts[own.at] == other.text.strip()
        }
        shared = sum(len(self.texts[i]) for i in places)
        return list(places), places, shared > COPY * self.characters

    def template(self, page: Page) -> set[int]:
        """Text nodes of a page that are template."""
        if not self.constant:
            return set()
        _, places, _ = self.compare(page)
        return {there for own, there in places.items() if own in self.constant}


def _choose(skeletons: list[Skeleton], page: Page) -> int:
    layout = outline(page.root)
    return next((i for i, s in enumerate(skeletons) if s.layout == layout), 0)


def _offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages per host and layout seen by a task, with the shortest of each."""
    best: dict[tuple[str, str], list] = {}
    held = 0

    def handed() -> pa.RecordBatch:
        keys = list(best)
        return pa.record_batch(
            {
                "host": pa.array([k[0] for k in keys], pa.string()),
                "layout": pa.array([k[1] for k in keys], pa.string()),
                "n": pa.array([best[k][0] for k in keys], pa.int64()),
                "html": pa.array([best[k][1] for k in keys], pa.string()),
            }
        )

    for batch in batches:
        for name, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            key = (name, outline(parse(html)))
            seen = best.get(key)
            if seen is None:
                best[key] = [1, html]
                held += len(html) + 200
            else:
                seen[0] += 1
                if (len(html), html) < (len(seen[1]), seen[1]):
                    held += len(html) - len(seen[1])
                    seen[1] = html
            if held > HELD_BYTES:
                yield handed()
                best.clear()
                held = 0
    if best:
        yield handed()


def skeletons(pages: DataFrame, layouts: int = LAYOUTS) -> DataFrame:
    """(host, skeletons): the shortest page of each frequent layout of a host."""
    offered = pages.select("host", "html").mapInArrow(
        _offer, "host string, layout string, n bigint, html string"
    )
    shortest = offered.groupBy("host", "layout").agg(
        F.sum("n").alias("n"), F.min(F.struct(F.length("html").alias("l"), "html")).alias("s")
    )
    order = W.partitionBy("host").orderBy(F.desc("n"), "layout")
    return (
        shortest.where("n > 1")
        .withColumn("at", F.row_number().over(order))
        .where(F.col("at") <= layouts)
        .groupBy("host")
        .agg(F.array_sort(F.collect_list(F.struct("at", "layout", "s.html"))).alias("skeletons"))
    )


def _read_skeletons(column: pa.Array) -> Iterator[tuple[int, list[Skeleton]]]:
    """Row number and skeletons of each row; equal neighbours are parsed once."""
    last, read = None, []
    for i, found in enumerate(column.to_pylist()):
        if found != last:
            last = found
            read = [
                Skeleton(s["layout"], s["html"], frozenset(s.get("constant") or ()))
                for s in found or ()
            ]
        yield i, read


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per skeleton text, how many pages repeat it; node -1 counts the pages themselves."""
    counts: dict[tuple[str, int, int], int] = {}

    def handed() -> pa.RecordBatch:
        keys = list(counts)
        return pa.record_batch(
            {
                "host": pa.array([k[0] for k in keys], pa.string()),
                "at": pa.array([k[1] for k in keys], pa.int32()),
                "node": pa.array([k[2] for k in keys], pa.int32()),
                "n": pa.array([counts[k] for k in keys], pa.int64()),
            }
        )

    for batch in batches:
        names, pages = batch.column("host").to_pylist(), batch.column("html").to_pylist()
        for i, known in _read_skeletons(batch.column("skeletons")):
            page = Page(pages[i])
            chosen = _choose(known, page)
            same, _, copy = known[chosen].compare(page)
            if copy:
                continue
            for node in (-1, *same):
                key = (names[i], chosen, node)
                counts[key] = counts.get(key, 0) + 1
        if len(counts) > 100_000:
            yield handed()
            counts.clear()
    if counts:
        yield handed()


def induce(pages: DataFrame, layouts: int = LAYOUTS) -> DataFrame:
    """(host, skeletons) with the template texts of each skeleton, from pages with host and html."""
    found = materialize(skeletons(pages, layouts), "skeletons")
    counted = (
        pages.join(found, "host")
        .select("host", "html", "skeletons")
        .mapInArrow(_count, "host string, at int, node int, n bigint")
        .groupBy("host", "at", "node")
        .agg(F.sum("n").alias("n"))
    )
    # one row per skeleton text from here on
    pages_of = F.max(F.when(F.col("node") == -1, F.col("n"))).over(W.partitionBy("host", "at"))
    constant = (
        counted.withColumn("pages", pages_of)
        .where((F.col("node") >= 0) & (F.col("pages") >= EVIDENCE))
        .where(F.col("n") >= F.lit(CONSTANT) * F.col("pages"))
        .groupBy("host", "at")
        .agg(F.sort_array(F.collect_list("node")).alias("constant"))
    )
    single = found.select("host", F.inline("skeletons"))
    return (
        single.join(constant.withColumn("at", F.col("at") + 1), ["host", "at"], "left")
        .groupBy("host")
        .agg(
            F.array_sort(F.collect_list(F.struct("at", "layout", "html", "constant"))).alias(
                "skeletons"
            )
        )
    )


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        pages = batch.column("html").to_pylist()
        for i, known in _read_skeletons(batch.column("skeletons")):
            page = Page(pages[i] or "")
            template = known[_choose(known, page)].template(page) if known else set()
            page.judge(template)
            texts.append(page.text())
        yield pa.record_batch(
            {
                "page_id": batch.column("page_id"),
                "url": batch.column("url"),
                "text": pa.array(texts, pa.string()),
                "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            }
        )


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages with page_id, url and html."""
    own = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
        host(F.col("url")).alias("host"),
    )
    wrappers = materialize(induce(own.where("host != '' and html is not null")), "wrappers")
    return own.join(wrappers, "host", "left").drop("host").mapInArrow(_extract, OUTPUT)
