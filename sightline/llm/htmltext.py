"""Main text of web pages by minimum-cut labelling.

A page becomes a graph of its text blocks and of the elements that hold them. A
classifier's log-odds for content are the capacities of a node's edge to one of
two terminals: a block's are about its text alone (size, links, sentence signs),
an element's are about its place (tags, roles, class names, those around it) and
count once for each block that it holds. Smoothness edges join each block to its
element, each element to the one around it, and blocks that follow each other. The
maximum flow, run on every page, separates content from boilerplate: a short line
goes with the article that holds it, a long advertisement with its box, and where
no place says anything the blocks of one element settle it among themselves.
"""

from __future__ import annotations

import re
from collections import deque
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import arrow_map, raw_texts

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?:svg|math)(?=[\s/])(?:[^>\"'/]|/(?!>)|\"[^\"]*\"|'[^']*')*/>"
    r"|<(?P<raw>script|style|noscript|template|title|iframe|svg|math|textarea|object|select)(?=[\s/>]|\Z)(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*?)/?(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S | re.I,
)
# One attribute at a time, so that names within others' names or values don't count.
_ATTR = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s"'>]+)))?""")

# Elements that begin and end a block of text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split())
_CLOSES_P = BLOCKS - {"head", "html", "body", "tr", "tbody", "thead", "tfoot", "caption"}
_LISTS = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dd dt", ("dl",)), "dd": ("dd dt", ("dl",)), "tr": ("tr", ("table",))}
_HARD = frozenset("nav footer aside form menu dialog fieldset head search button".split())
_HARD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())

# Words of class and id names.
_STICKY = re.compile(
    r"\b(?:ads?|adverts?|advertisement|advertising|adsense|adbox|adunit|sponsor|sponsored|promo|promotion|promoted|comment|comments|commentlist|disqus|replies|respond|reader|readers|discussion|"
    r"cookie|cookies|consent|gdpr|notice|notices|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|nav|navbar|navigation|topnav|menu|mainmenu|submenu|breadcrumb|breadcrumbs|pagination|pager|"
    r"share|sharing|social|related|recommended|recommendations|footer|foot|copyright|skip|toolbar|taboola|outbrain)\b",
    re.I,
)
_SIDE = re.compile(r"\b(?:topbar|banner|sidebar|aside|widget|widgets|rail|side|alert|legal|disclaimer|hidden)\b", re.I)
_SOFT = re.compile(r"\b(?:header|masthead|tags|categories|meta)\b", re.I)
# An article's own classes often name its topic; only these say what it is.
_NOT_ARTICLE = re.compile(r"(?:^|\s)(?:comments?|replies|reply|ads?|advert|sponsored|promo|related)(?:[-_]\S*)?(?:\s|$)", re.I)
# Words of layout that speak of what is elsewhere on the page.
_LAYOUT = re.compile(r"\b(?:with|has|have|no|without|is|show|hide|enable|enabled|open|closed)[-_ ]+\w+", re.I)
_GOOD = re.compile(r"\b(?:article|articlebody|content|main|post|entry|story|body|text|prose)\b", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[_\-\d]+")

#: Log-odds of content for a block's place; a text's own lie between -3.8 and 2.5.
HARD, SOFT, ARTICLE, GOOD = -4.0, -4.0, 4.0, 2.5
#: Smoothness: of a block and its element (more, the surer the place), of an element
#: and the one around it, of neighbours in one element and in two.
HELD, HELD_BY_PLACE, AROUND, NEXT, NEXT_ELSEWHERE = 1.5, 0.75, 0.5, 0.4, 0.2


class _Element:
    __slots__ = ("good", "hard", "node", "parent", "soft", "tag")

    def __init__(self, tag: str, attrs: str, parent: _Element | None):
        self.tag, self.parent = tag, parent
        self.node = -1
        self.good = parent.good if parent else 0
        self.hard = parent.hard if parent else False
        self.soft = parent.soft if parent else False
        names, role, gone = "", "", False
        if attrs:
            for m in _ATTR.finditer(attrs):
                value = m[2] or m[3] or m[4] or ""
                key = m[1].lower()
                if key in ("class", "id", "itemprop"):
                    names += " " + value
                elif key == "role":
                    role = value.lower().strip()
                elif key == "hidden" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    gone = True
        if tag in ("article", "main") or role in ("main", "article"):
            self.good, self.soft = 2, False
        if tag in _HARD or role in _HARD_ROLES or gone or tag == "header" and self.good < 2:
            self.hard = True
        elif tag == "article":
            self.hard = self.hard or bool(_NOT_ARTICLE.search(names))
        elif names and tag not in ("html", "body", "main"):
            names = _CAMEL.sub(" ", _LAYOUT.sub(" ", names))
            if _STICKY.search(names):
                self.hard = True
            elif _SIDE.search(names):
                # Beside the article: inside it never text, around it perhaps a
                # frame that also holds the article.
                self.hard, self.soft = self.hard or self.good == 2, True
            elif _SOFT.search(names):
                self.soft = self.good < 2
            elif _GOOD.search(names):
                self.good = max(self.good, 1)


def blocks(page: str) -> tuple[list[tuple[str, float, int]], list[tuple[float, int]]]:
    """``(text, log-odds of content, number of its element)`` for each block with
    text, in page order, and ``(log-odds of content, number of the next element
    around it that holds blocks or -1)`` for each element that holds blocks."""
    stack = [_Element("", "", None)]
    out: list[tuple[str, float, int]] = []
    holders: list[_Element] = []
    pieces: list[str] = []
    linked, links = 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split()) if pieces else ""
        pieces.clear()
        if text:
            top = stack[-1]
            holder = stack[-2] if len(stack) > 1 and top.tag in ("p", "li", "tr", "dd", "dt", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote") else top
            if holder.node < 0:
                holder.node = len(holders)
                holders.append(holder)
            out.append((text, text_odds(text, top.tag, min(1.0, linked / len(text))), holder.node))
        linked = 0

    def leave(depth: int) -> None:
        del stack[depth:]

    low = 0
    for m in _TOKEN.finditer(page):
        if m.start() > low:
            run = page[low : m.start()]
            run = unescape(run) if "&" in run else run
            pieces.append(run)
            if links:
                linked += len(run)
        low = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag, end, attrs = tag.lower(), m["end"] or m["end2"], m["attrs"] or m["attrs2"]
        if tag == "a":
            links = 0 if end else 1
        elif tag in ("br", "td", "th"):
            pieces.append(" ")
        elif tag == "button":
            # Inline, but never content.
            flush()
            if not end:
                stack.append(_Element(tag, "", stack[-1]))
            elif stack[-1].tag == "button":
                stack.pop()
        elif tag in BLOCKS:
            flush()
            if end:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == tag:
                        leave(depth)
                        break
                continue
            if tag in _CLOSES_P and stack[-1].tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and (stack[-1].tag == "p" or tag[0] == "h" and len(tag) == 2):
                stack.pop()
            if tag in _LISTS:
                same, bound = _LISTS[tag]
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag in bound:
                        break
                    if stack[depth].tag in same.split():
                        leave(depth)
                        break
            if tag != "hr":
                stack.append(_Element(tag, attrs, stack[-1]))
    if low < len(page):
        run = page[low:]
        pieces.append(unescape(run) if "&" in run else run)
    flush()
    return out, [(place_odds(h), _around(h)) for h in holders]


def _around(at: _Element) -> int:
    while at.parent is not None:
        at = at.parent
        if at.node >= 0:
            return at.node
    return -1


def place_odds(at: _Element) -> float:
    """Linear classifier over the places that an element is in."""
    if at.hard:
        return HARD
    return ARTICLE * (at.good == 2) + GOOD * (at.good == 1) + SOFT * at.soft


def text_odds(text: str, tag: str, linked: float) -> float:
    """Linear classifier over size, links and sentence signs."""
    score = min(len(text), 240) / 80 - 1.5 - 2.0 * linked + 0.5 * any(c in text for c in ".!?;:")
    return score + {"p": 0.5, "h1": 0.5, "h2": 0.5, "h3": 0.5, "blockquote": 0.5, "pre": 0.5, "li": -0.3}.get(tag, 0.0)


def graph(found: list[tuple[str, float, int]], holders: list[tuple[float, int]]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Terminal capacities and smoothness edges; blocks first, then elements."""
    n = len(found)
    held = [0] * len(holders)
    edges = []
    for i, (_, _, at) in enumerate(found):
        held[at] += 1
        edges.append((i, n + at, HELD + HELD_BY_PLACE * abs(holders[at][0])))
        if i:
            edges.append((i - 1, i, NEXT if found[i - 1][2] == at else NEXT_ELSEWHERE))
    edges += [(n + k, n + around, AROUND) for k, (_, around) in enumerate(holders) if around >= 0]
    return [own for _, own, _ in found] + [place * k for (place, _), k in zip(holders, held, strict=True)], edges


def min_cut(terminal: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Sides of a minimum cut: true for the source's. A positive terminal is the
    capacity from the source, a negative one that to the sink; edges go both ways.
    Of several minimum cuts the one with most nodes on the source's side."""
    unit, n = 1000, len(terminal)
    flow = _Flow(n + 2)
    for i, t in enumerate(terminal):
        if t > 0:
            flow.add(n, i, round(t * unit), 0)
        elif t < 0:
            flow.add(i, n + 1, round(-t * unit), 0)
    for a, b, w in edges:
        flow.add(a, b, round(w * unit), round(w * unit))
    flow.run(n, n + 1)
    lost = flow.reaching(n + 1)
    return [i not in lost for i in range(n)]


class _Flow:
    """Dinic's algorithm without recursion."""

    def __init__(self, n: int):
        self.at: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.cap: list[int] = []

    def add(self, a: int, b: int, there: int, back: int) -> None:
        for x, y, c in ((a, b, there), (b, a, back)):
            self.at[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)

    def run(self, source: int, sink: int) -> None:
        while True:
            level = {source: 0}
            queue = deque([source])
            while queue:
                x = queue.popleft()
                for e in self.at[x]:
                    if self.cap[e] and self.to[e] not in level:
                        level[self.to[e]] = level[x] + 1
                        queue.append(self.to[e])
            if sink not in level:
                return
            turn = [0] * len(self.at)
            path: list[int] = []
            x = source
            while True:
                if x == sink:
                    least = min(self.cap[e] for e in path)
                    for e in path:
                        self.cap[e] -= least
                        self.cap[e ^ 1] += least
                    k = next(k for k, e in enumerate(path) if not self.cap[e])
                    x = self.to[path[k] ^ 1]
                    del path[k:]
                    continue
                while turn[x] < len(self.at[x]):
                    e = self.at[x][turn[x]]
                    if self.cap[e] and level.get(self.to[e], -1) == level[x] + 1:
                        break
                    turn[x] += 1
                if turn[x] < len(self.at[x]):
                    path.append(self.at[x][turn[x]])
                    x = self.to[path[-1]]
                elif path:
                    x = self.to[path.pop() ^ 1]
                    turn[x] += 1
                else:
                    break

    def reaching(self, sink: int) -> set[int]:
        """Nodes with residual capacity to the sink."""
        seen, queue = {sink}, deque([sink])
        while queue:
            x = queue.popleft()
            for e in self.at[x]:
                if self.cap[e ^ 1] and self.to[e] not in seen:
                    seen.add(self.to[e])
                    queue.append(self.to[e])
        return seen


def main_text(page: str) -> str:
    found, holders = blocks(page)
    kept = min_cut(*graph(found, holders))
    return "\n".join(text for (text, _, _), keep in zip(found, kept[: len(found)], strict=True) if keep)


def _extract():
    def step(batch):
        texts = [main_text(raw.decode(errors="replace")) for raw in raw_texts(batch.column(2))]
        return batch.column(0), batch.column(1), texts, [len(t) for t in texts]

    return step


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)``, a row for each row of ``pages``; null and
    empty pages and pages without content: an empty text. Pages that break off are
    read to where they end; an unfinished tag, comment or script is dropped."""
    return arrow_map(pages, {"page_id": F.col(page_id).cast("long"), "url": F.col(url), "html": F.col(html)}, _extract, "page_id long, url string, text string, n_chars long", batch_rows=500)
