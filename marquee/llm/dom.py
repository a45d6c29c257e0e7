"""A small DOM of one page, and the alignment of two of them by simple tree matching.

Helpers for one page inside a Spark task. Markup is read as browsers do where it matters for text:
comments and raw text elements, implied end tags, stray and missing end tags, unclosed tags at the
end. Elements deeper than MAX_DEPTH become children of the element at that depth, so no nesting
overflows the stack and no text is lost.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

MAX_DEPTH = 120
# Children lists of more pairs than this are aligned by equal children only.
MAX_CELLS = 40_000

TEXT = "#text"
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset"
    " figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav"
    " ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEAD = frozenset("base link meta noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# A start tag ends an open element of the first set, unless one of the second is nearer.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"])),
}
WALLS = frozenset("table td th caption html object button".split())
ENDS_P = BLOCK - frozenset(
    "body caption dd dt html legend li optgroup option tbody td tfoot th thead tr".split()
)

TOKEN = re.compile(
    r"<!--(?:>|->|.*?--!?>|.*\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"
    r"|<[!?/][^>]*+>"
    r"|<[a-zA-Z!?/][^>]*\Z",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
DIGITS = re.compile(r"\d+")


class Node:
    """An element, or a text with tag TEXT. `at` is its place in document order."""

    __slots__ = ("tag", "raw", "text", "kids", "up", "label", "at")

    def __init__(self, tag: str, raw: str = "", up: Node | None = None, text: str = ""):
        self.tag, self.raw, self.text, self.up = tag, raw, text, up
        self.kids: list[Node] = []
        self.at = -1
        self.label = tag if "class" not in raw else f"{tag}.{_classes(raw)}"

    def attributes(self) -> dict[str, str]:
        if not self.raw:
            return {}
        return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(self.raw)}


def _classes(raw: str) -> str:
    for m in ATTRIBUTE.finditer(raw):
        if m[1].lower() == "class":
            return DIGITS.sub("", (m[2] or m[3] or m[4] or "").lower())
    return ""


def parse(html: str) -> Node:
    """The page as a tree below one `html` element."""
    root = Node("html")
    stack = [root]
    names = ["html"]
    at = 0

    def add_text(text: str) -> None:
        if text and not text.isspace():
            top = stack[-1]
            top.kids.append(Node(TEXT, "", top, text))

    def close(wanted: frozenset[str], walls: frozenset[str]) -> None:
        for i in range(len(names) - 1, 0, -1):
            if names[i] in wanted:
                del stack[i:], names[i:]
                return
            if names[i] in walls:
                return

    just_p = frozenset(["p"])
    search = TOKEN.search
    while True:
        found = search(html, at)
        if found is None:
            add_text(html[at:])
            break
        begin, end = found.span()
        if begin > at:
            add_text(html[at:begin])
        at = end
        name = found[2] or found[5]
        if name is None:
            continue
        name = name.lower()
        if found[1] or found[4]:
            _end_tag(name, stack, names)
            continue
        raw = found[3] or found[6] or ""
        if name in ("html", "body", "head"):
            if name == "body" and "body" not in names:
                del stack[1:], names[1:]
            elif name == "html" or name in names:
                continue
        if names[-1] == "head" and name not in HEAD:
            del stack[-1], names[-1]
        if name in ENDS_P and "p" in names:
            close(just_p, WALLS)
        if name in HEADINGS and names[-1] in HEADINGS:
            del stack[-1], names[-1]
        if name in ENDS:
            close(*ENDS[name])
        node = Node(name, raw, stack[-1])
        stack[-1].kids.append(node)
        if name in VOID:
            continue
        if name in RAW:
            ending = re.compile(f"</{name}(?=[\\s/>])[^>]*>", re.IGNORECASE).search(html, at)
            node.text = html[at : ending.start()] if ending else html[at:]
            at = ending.end() if ending else len(html)
            continue
        if len(stack) < MAX_DEPTH:
            stack.append(node)
            names.append(name)
    for i, node in enumerate(walk(root)):
        node.at = i
    return root


def _end_tag(name: str, stack: list[Node], names: list[str]) -> None:
    """Leave the nearest open element of that name; inline ones never end a block."""
    block = name in BLOCK
    for i in range(len(names) - 1, 0, -1):
        if names[i] == name:
            if name not in ("body", "html"):  # what follows these still belongs to the page
                del stack[i:], names[i:]
            return
        if (names[i] in WALLS and name not in ("table", "tr", "tbody", "thead", "tfoot")) or (
            not block and names[i] in BLOCK
        ):
            return


def walk(root: Node) -> Iterator[Node]:
    """All nodes in document order."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(reversed(node.kids))


def outline(root: Node) -> str:
    """The labels of the body's children, runs of equal ones as one."""
    body = next((n for n in root.kids if n.tag == "body"), root)
    labels = [n.label for n in body.kids if n.tag != TEXT and n.tag not in RAW]
    return " ".join(x for i, x in enumerate(labels) if i == 0 or labels[i - 1] != x)


def align(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Pairs of text nodes of two trees under their largest common ordered matching.

    Simple tree matching: two nodes match if their labels do, and then the matching of their
    children, in order, is the one with the largest sum, by dynamic programming. Texts weigh more
    where they are equal, so that of several largest matchings the one with most equal texts wins.
    """
    memo: dict[tuple[int, int], float] = {}
    equal = {id(n): n.text.strip() for root in (a, b) for n in walk(root) if n.tag == TEXT}

    def weight(x: Node, y: Node) -> float:
        if x.tag == TEXT:
            return (1.5 if equal[id(x)] == equal[id(y)] else 1.0) if y.tag == TEXT else 0.0
        if x.label != y.label:
            return 0.0
        if not x.kids or not y.kids:
            return 1.0
        if len(x.kids) == 1 == len(y.kids):
            return 1.0 + weight(x.kids[0], y.kids[0])
        key = (x.at, y.at)
        found = memo.get(key)
        if found is None:
            found = memo[key] = 1.0 + table(x.kids, y.kids)[-1][-1]
        return found

    def table(xs: list[Node], ys: list[Node]) -> list[list[float]]:
        rows = [[0.0] * (len(ys) + 1)]
        if len(xs) * len(ys) > MAX_CELLS:
            return rows
        for x in xs:
            above, row, left = rows[-1], [0.0], 0.0
            for j, y in enumerate(ys):
                best = above[j + 1] if above[j + 1] > left else left
                w = weight(x, y)
                if w and above[j] + w > best:
                    best = above[j] + w
                row.append(best)
                left = best
            rows.append(row)
        return rows

    pairs: list[tuple[Node, Node]] = []
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        if x.tag == TEXT:
            pairs.append((x, y))
            continue
        xs, ys = x.kids, y.kids
        if not xs or not ys:
            continue
        if len(xs) * len(ys) > MAX_CELLS:
            todo.extend(_equal_children(xs, ys))
            continue
        rows = table(xs, ys)
        i, j = len(xs), len(ys)
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                todo.append((xs[i], ys[j]))
    return pairs


def _equal_children(xs: list[Node], ys: list[Node]) -> list[tuple[Node, Node]]:
    """Children with equal markup and text, in order; all that constancy asks of long lists."""

    def shape(node: Node) -> str:
        return "\0".join(n.label + n.text.strip() for n in walk(node))

    places: dict[str, list[int]] = {}
    for j, y in enumerate(ys):
        places.setdefault(shape(y), []).append(j)
    pairs, last = [], -1
    for x in xs:
        at = places.get(shape(x), [])
        k = bisect_right(at, last)
        if k < len(at):
            last = at[k]
            pairs.append((x, ys[last]))
    return pairs
