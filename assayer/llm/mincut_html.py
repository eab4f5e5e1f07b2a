"""Main text of web pages by minimum-cut labelling.

A page becomes a chain of text blocks. A linear classifier over a block's place
in the DOM and its wording gives it a cost for being called content and one for
being called boilerplate; these are the capacities from and to the terminals.
Neighbouring blocks are joined by edges, stronger the closer they are in the DOM,
so a short line inside an article follows its surroundings. The minimum cut, found
by maximum flow, is the cheapest labelling of the whole page.

Each page is one task-local problem: pages are never shuffled.

Defined cases: a null or empty page, and one without content, has an empty text;
broken or cut-off markup is read as far as it goes; repeated rows are judged
each; an empty table gives an empty result; further columns are kept, but for
those named like a result.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict, deque
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot "
    "th thead tr ul".split()
)
#: Never text of the page.
SILENT = set("audio button canvas datalist embed head iframe math noscript object script select style svg template textarea title video".split())
#: An opening tag that ends an open one of the same kind.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Containers that such an implied end does not leave.
BORDER = set("article aside body div dl footer form header main nav ol section table td ul".split())

#: Weights of the classifier: natural logarithms of odds, positive for content.
TAG_WEIGHT = {
    "nav": -9.0, "footer": -9.0, "header": -4.0, "aside": -9.0, "form": -9.0, "menu": -9.0, "dialog": -9.0, "fieldset": -4.0,
    "article": 4.0, "main": 3.0,
}
OWN_TAG_WEIGHT = {"p": 1.0, "h1": 1.0, "h2": 0.8, "h3": 0.6, "li": -0.4, "pre": 1.0, "blockquote": 0.6, "address": -2.0}
ROLE_WEIGHT = {
    "navigation": -9.0, "banner": -6.0, "contentinfo": -9.0, "complementary": -9.0, "search": -9.0, "dialog": -9.0,
    "alert": -9.0, "menu": -9.0, "form": -9.0, "article": 4.0, "main": 3.0,
}
NOISE = re.compile(
    r"(?:^|[-_\s])(?:ads?|adverts?|advertisements?|advertising|banners?|breadcrumbs?|comments?|consent|cookies?|copyright|"
    r"disclaimers?|disqus|foot|footer|gdpr|header|legal|login|masthead|menu|modal|nav|navbar|navigation|newsletters?|notices?|"
    r"alerts?|overlay|pager|pagination|popups?|promos?|promotions?|recommended|related|replies|reply|reviews?|search|share|"
    r"sharing|sidebars?|signup|skip|social|sponsors?|sponsored|subscribe|subscription|tags|teasers?|toolbar|widgets?)(?:$|[-_\s\d])"
)
SIGNAL = re.compile(r"(?:^|[-_\s])(?:article|body|content|entry|main|post|prose|story|text)(?:$|[-_\s])")
#: Words of NOISE that also name parts of an article; inside one they count for nothing, and neither does its own header.
INNER = re.compile(r"(?:^|[-_\s])(?:foot|header|legal|reviews?|search|tags)(?=$|[-_\s\d])")
NOISE_WEIGHT, SIGNAL_WEIGHT, LINK_WEIGHT, RIGHTS_WEIGHT, BIAS = -8.0, 1.5, -5.0, -4.0, -0.5
RIGHTS = re.compile(r"©|\(c\) *\d{4}|all rights reserved", re.IGNORECASE)
#: Strength of the tie between neighbours, by the tags between them in the DOM.
TIE, SCALE = 1.6, 1000


@dataclass
class Node:
    tag: str
    weight: float
    hidden: bool
    depth: int
    parent: Node | None
    #: Depth of the nearest element that an implied end does not leave, and whether an article is around.
    border: int = 0
    article: bool = False
    #: The nearest block element, itself included.
    home: Node | None = None


@dataclass
class Block:
    node: Node
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    @property
    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def _own_weight(tag: str, attributes: dict[str, str | None], in_article: bool) -> float:
    weight = 0.0 if in_article and tag in ("article", "header") else TAG_WEIGHT.get(tag, 0.0)
    weight += ROLE_WEIGHT.get((attributes.get("role") or "").lower(), 0.0)
    names = f"{attributes.get('class') or ''} {attributes.get('id') or ''}".lower()
    if names != " " and tag not in ("html", "body"):
        if NOISE.search(INNER.sub(" ", names) if in_article else names):
            weight += NOISE_WEIGHT
        elif SIGNAL.search(names):
            weight += SIGNAL_WEIGHT
    return weight


class Blocks(HTMLParser):
    """Collects the text blocks of a page with their place in the tree."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.node = Node("", 0.0, False, 0, None)
        self.node.home = self.node
        #: Depths at which an element of a name is open.
        self.at: defaultdict[str, list[int]] = defaultdict(list)
        self.blocks: list[Block] = []
        self.open: Block | None = None
        self.links = 0

    def parse_html_declaration(self, i: int) -> int:
        return super().parse_html_declaration(i) if self.rawdata[i : i + 3] != "<![" else self.parse_bogus_comment(i)

    def _leave(self, tags: set[str], bordered: bool = True) -> None:
        """Close the nearest open element of ``tags``, unless ``bordered`` and a border stands before it."""
        depth = max((self.at[tag][-1] for tag in tags if self.at[tag]), default=0)
        if not depth or bordered and self.node.border > depth:
            return
        while self.node.depth >= depth:
            self.at[self.node.tag].pop()
            self.links -= self.node.tag == "a"
            self.node = self.node.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.open = None
        if tag == "br":
            self.handle_data(" ")
        if tag in VOID:
            return
        if tag in CLOSES:
            self._leave(CLOSES[tag])
        elif tag in BLOCK:
            self._leave({"p"})
        given = dict(attrs)
        hidden = (
            self.node.hidden or tag in SILENT or "hidden" in given or given.get("aria-hidden") == "true"
            or re.search(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", given.get("style") or "") is not None
        )
        above, depth = self.node, self.node.depth + 1
        weight = above.weight + _own_weight(tag, given, above.article)
        border = depth if tag in BORDER else above.border
        self.node = Node(tag, weight, hidden, depth, above, border, above.article or tag == "article", above.home)
        if tag in BLOCK:
            self.node.home = self.node
        self.at[tag].append(depth)
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash does not close an HTML element

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.open = None
        if tag == "br":
            self.handle_data(" ")
        self._leave({tag}, tag not in BLOCK)

    def handle_data(self, data: str) -> None:
        if self.node.hidden:
            return
        if self.open is None:
            if not data.strip():
                return
            self.open = Block(self.node.home)
            self.blocks.append(self.open)
        self.open.parts.append(data)
        if self.links:
            self.open.linked += len(data)


def content_score(block: Block, text: str) -> float:
    """Log odds that a block is content."""
    size = len(text)
    score = BIAS + block.node.weight + OWN_TAG_WEIGHT.get(block.node.tag, 0.0)
    score += max(-1.5, min(2.5, math.log2(size / 40)))
    score += LINK_WEIGHT * min(1.0, block.linked / size)
    if text[-1] in ".!?。…":
        score += 0.7
    if RIGHTS.search(text):
        score += RIGHTS_WEIGHT
    return score


def _distance(a: Node, b: Node) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def min_cut(scores: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source in the minimum cut.

    Positive scores are capacities from the source, negative ones to the sink;
    flow is pushed along shortest paths, level by level.
    """
    n = len(scores)
    source, sink = n, n + 1
    heads: list[int] = []
    room: list[int] = []
    edges: list[list[int]] = [[] for _ in range(n + 2)]

    def connect(a: int, b: int, there: int, back: int) -> None:
        edges[a].append(len(heads))
        heads.append(b)
        room.append(there)
        edges[b].append(len(heads))
        heads.append(a)
        room.append(back)

    for k, score in enumerate(scores):
        size = round(abs(score) * SCALE)
        if score > 0:
            connect(source, k, size, 0)
        elif size:
            connect(k, sink, size, 0)
    for a, b, weight in ties:
        connect(a, b, round(weight * SCALE), round(weight * SCALE))

    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            at = queue.popleft()
            for e in edges[at]:
                if room[e] and level[heads[e]] < 0:
                    level[heads[e]] = level[at] + 1
                    queue.append(heads[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        at = source
        while True:
            if at == sink:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                cut = next(k for k, e in enumerate(path) if not room[e])
                at = heads[path[cut] ^ 1]
                del path[cut:]
                continue
            while turn[at] < len(edges[at]):
                e = edges[at][turn[at]]
                if room[e] and level[heads[e]] == level[at] + 1:
                    break
                turn[at] += 1
            if turn[at] < len(edges[at]):
                path.append(e)
                at = heads[e]
            elif at == source:
                break
            else:
                level[at] = -1
                at = heads[path.pop() ^ 1]


def main_text(html: str | None) -> str:
    """Content blocks of a page in order, one line each."""
    if not html:
        return ""
    parser = Blocks()
    parser.feed(html)
    parser.close()
    found = [(block, text) for block in parser.blocks if (text := block.text)]
    if not found:
        return ""
    scores = [content_score(block, text) for block, text in found]
    ties = [
        (k, k + 1, TIE / (1 + _distance(found[k][0].node, found[k + 1][0].node))) for k in range(len(found) - 1)
    ]
    last: dict[int, int] = {}
    for k, (block, _) in enumerate(found):  # the previous block of the same container, when others stand between
        container = id(block.node.parent)
        if container in last and last[container] != k - 1:
            ties.append((last[container], k, TIE / 4))
        last[container] = k
    return "\n".join(text for (_, text), kept in zip(found, min_cut(scores, ties), strict=True) if kept)


def extract(pages: DataFrame) -> DataFrame:
    """Add text and n_chars to rows with ``html``."""

    @F.pandas_udf("string")
    def text_of(htmls: pd.Series) -> pd.Series:
        return pd.Series([main_text(html) for html in htmls], dtype=object)

    rows = pages.withColumn("text", text_of("html"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
