"""HTML extraction: minimum-cut labelling of a page's text blocks.

A page becomes its text blocks, each with the element that holds it. One scan finds them, in time linear in the page: where a tag ends,
which open element an end tag closes and how far blocks lie apart never need a look at the rest of the page. A logistic classifier over block features gives each block a cost of
being called content and one of being called boilerplate: the capacities of its edges to the two terminals. Neighbours in page order and
the next blocks under the same parent are tied by smoothness edges that weaken with their distance in the tree. A minimum cut separates
content from boilerplate: blocks whose terminal capacity outweighs all their ties are settled first, which no minimum cut contradicts;
flow is pushed on from blocks with at most two open neighbours; augmenting paths decide the rest.

The classifier is trained here: PRIOR holds what the features are expected to say, and weak labels of up to SAMPLE pages (blocks inside
article or main and outside any marked boilerplate element, against blocks inside such elements) move it by penalised logistic
regression. Class names and ids are features among others: names of adverts, menus, comments and notices weigh much everywhere,
ambiguous ones (legal, related, footer) and names that only hold such a word (related-work, footer-note) weigh little inside an article.
Scripts, styles, forms and other unseen elements never give blocks; those that stand inside a line (a script, a button, a drawing) don't
end the block around them either, and a formula's text belongs to it. A form that holds the article (a page whose whole body is one form)
is no form. Inside an article links and an ambiguous name alone say nothing: a list of references stays under its heading, a section named
"more" too, unless there is a second sign (an ambiguous name with mostly links or without a sentence's end).

Nulls: a null or empty html gives an empty text. Null ids and urls stay null; repeated rows are separate rows. Extra columns are
ignored. An empty table gives no rows. White space is what str.split() takes, no-break spaces included.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, slices, typed

SAMPLE = 512
#: A comment, a section of characters, a start or end tag's name, or a declaration.
OPEN = re.compile(r"<!--|<!\[CDATA\[|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)|<[!?]")
#: A tag's attributes, up to its end: a quoted ">" doesn't end it.
REST = re.compile(r"((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>")
#: Elements whose insides are never page text.
UNSEEN = frozenset("script style noscript template head title iframe svg object select option datalist textarea button canvas audio video map form annotation annotation-xml".split())
#: Of these and of void elements, the ones that stand inside a line: they don't end a block.
WITHIN = frozenset("script style noscript template iframe svg object select option datalist textarea button canvas audio video map annotation annotation-xml input embed area link meta param source track".split())
#: Of these, the ones whose insides are no markup either.
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts none semantics".split())
#: A start tag on the left closes an open element on the right that stands in the same container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = frozenset("div section article main aside nav header footer ul ol dl table td th blockquote body html form figure".split())
BOILER_TAGS = frozenset("nav footer aside menu dialog".split())
#: Parts of class names and ids, between "-" and "_": of page furniture, of what may be furniture, and those that say nothing.
FURNITURE = re.compile(r"ad|ads|advert\w*|adbox|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|popup|modal|newsletter|subscri\w*|sidebar|rail|widgets?|menu|nav\w*|breadcrumb\w*|pagination|pager|masthead|topbar|comments?|commentlist|disqus|reply|replies|respond|share|sharing|login|signup|toolbar|notices?|announcements?", re.IGNORECASE)
AMBIGUOUS = re.compile(r"side|footer|header|social|related|recommend\w*|more|trending|popular|tags|search|legal|copyright|disclaimer", re.IGNORECASE)
NEUTRAL = re.compile(r"\d*|box|bar|list|wrap|wrapper|container|section|area|block|buttons?|links?|form|items?|inner|outer|panel|col|column|posts?|module|main|top|bottom|left|right|global|site|page|primary|secondary|icons?|thread|unit|slot|group|title|stories|articles", re.IGNORECASE)
#: Neutral parts that make an ambiguous one sure: a list of links, not a part of a text.
LISTED = re.compile(r"bar|buttons?|links?|posts?|icons?|stories|articles|list|items?", re.IGNORECASE)
#: What a form holds that is a page and not a form.
HELD = re.compile(r"<(?:article|main|h1)\b", re.IGNORECASE)
CONTENT = re.compile(r"(?:^|[\s_-])(?:article\w*|content|post|entry|story|main|body|text|page-content)(?:$|[\s_-])", re.IGNORECASE)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.IGNORECASE)

FEATURES = ("bias", "inside article or main", "inside nav, footer, aside", "inside a header outside an article", "furniture's name", "ambiguous name inside an article with a second sign", "name that holds such a word", "such a name inside an article", "content name", "link share", "log length", "sentence end", "heading", "list item", "hidden")
PRIOR = np.array([-0.8, 4.0, -7.0, -5.0, -7.0, -4.4, -3.0, -0.5, 1.0, -3.0, 0.25, 0.4, 0.6, -0.8, -8.0])
TRUST = 40.0
TIE = 1.2


class Block:
    """flags: in article, in nav or the like, in page header, furniture's name, ambiguous name in article, holds such a word, the same in
    article, content name, heading, list item, hidden."""

    __slots__ = ("flags", "linked", "node", "text")

    def __init__(self, text: str, linked: float, node: Node, flags: tuple[bool, ...]) -> None:
        self.text, self.linked, self.node, self.flags = text, linked, node, flags


class Node:
    """An element that isn't inline."""

    __slots__ = ("depth", "up")

    def __init__(self, up: Node | None) -> None:
        self.up, self.depth = up, up.depth + 1 if up else 0


def apart(a: Node, b: Node) -> int:
    """Steps from a to b in the tree. From block to block these are no more than the elements opened and closed between them."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
        steps += 1
    return steps


class TagEnds:
    """Where a tag that is open at a place ends, for all places at once: made from the page's end on, for pages with unclosed quotes."""

    def __init__(self, page: str) -> None:
        marks = [(m.start(), m[0]) for m in re.finditer("[\"'>]", page)]
        self.place, self.end = [at for at, _ in marks], []
        outside = double = single = -1
        for at, mark in reversed(marks):
            if mark == ">":
                outside = at
            elif mark == '"':
                outside, double = double, outside
            else:
                outside, single = single, outside
            self.end.append(outside)
        self.end.reverse()

    def after(self, at: int) -> int:
        """The ">" that ends the tag, -1 if there is none."""
        i = bisect_left(self.place, at)
        return self.end[i] if i < len(self.end) else -1


def _kind(names: str) -> tuple[bool, bool, bool]:
    """Of a class or id: whether it names furniture, may name it, only holds such a word."""
    furniture = ambiguous = holds = False
    for token in names.split():
        parts = re.split("[-_]", token)
        sure = [bool(FURNITURE.fullmatch(x)) for x in parts]
        maybe = [bool(AMBIGUOUS.fullmatch(x)) for x in parts]
        if not any(sure) and not any(maybe):
            continue
        whole = all(s or m or NEUTRAL.fullmatch(x) for s, m, x in zip(sure, maybe, parts, strict=True))
        named = any(sure) or any(LISTED.fullmatch(x) for x in parts)
        furniture = furniture or whole and named
        ambiguous = ambiguous or whole and not named
        holds = holds or not whole
    return furniture, ambiguous, holds


def _marks(attributes: str) -> tuple[bool, bool, bool, bool, bool]:
    """(furniture, ambiguous, holds such a word, content, hidden) of an element's attributes."""
    furniture = ambiguous = holds = content = hidden = False
    if attributes and not attributes.isspace():
        for key, value in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key in ("class", "id"):
                found = _kind(value)
                furniture, ambiguous, holds = furniture or found[0], ambiguous or found[1], holds or found[2]
                content = content or bool(CONTENT.search(value))
            elif key == "role":
                furniture = furniture or value.lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar")
                content = content or value.lower() in ("main", "article")
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                hidden = True
            elif key == "style":
                hidden = hidden or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE))
    return furniture, ambiguous, holds, content, hidden


class Stack:
    """The open elements, innermost last: (name, node, flags, unseen). It knows the places of each name and of what isn't inline."""

    def __init__(self) -> None:
        self.items: list[tuple[str, Node, tuple[bool, ...], bool]] = []
        self.places: dict[str, list[int]] = {}
        self.block_places: list[int] = []
        self.holder_places: list[int] = [-1]
        self.push("", Node(None), (False,) * 11, False)

    def push(self, name: str, node: Node, flags: tuple[bool, ...], unseen: bool) -> None:
        at = len(self.items)
        self.items.append((name, node, flags, unseen))
        self.places.setdefault(name, []).append(at)
        if name not in INLINE:
            self.block_places.append(at)
        if name in HOLDERS:
            self.holder_places.append(at)

    def cut(self, depth: int) -> None:
        while len(self.items) > depth:
            name = self.items.pop()[0]
            self.places[name].pop()
            if name not in INLINE:
                self.block_places.pop()
            if name in HOLDERS:
                self.holder_places.pop()

    def last(self, name: str) -> int:
        """The innermost element of that name, 0 if none is open."""
        places = self.places.get(name)
        return places[-1] if places else 0

    def close(self, name: str) -> None:
        """An end tag; an inline one doesn't reach past an element that isn't inline."""
        depth = self.last(name)
        if depth and not (name in INLINE and self.block_places[-1] > depth):
            self.cut(depth)

    def start(self, name: str) -> None:
        """A start tag ends what can't hold it: a paragraph, or what CLOSES says, in the same container."""
        depth = max(self.last(x) for x in (*CLOSES.get(name, ()), "p"))
        if depth and depth >= self.holder_places[-1]:
            self.cut(depth)


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order; an inline element doesn't end a block, and a line break is white space."""
    out: list[Block] = []
    stack = Stack()
    texts: list[str] = []
    linked = in_link = at = text_at = 0
    ends: TagEnds | None = None
    last_end = page.rfind(">")
    form_ends = [m.start() for m in re.finditer("(?i)</form", page)]
    held = [m.start() for m in HELD.finditer(page)] if "<form" in page.lower() else []

    def holds_the_page(start: int) -> bool:
        """Whether the form that starts here has a page inside it."""
        i, j = bisect_left(held, start), bisect_left(form_ends, start)
        return i < len(held) and (j == len(form_ends) or held[i] < form_ends[j])

    def flush() -> None:
        nonlocal linked
        if texts:
            text = " ".join(entities.unescape("".join(texts)).split())
            if text:
                _, node, flags, _ = stack.items[-1]
                out.append(Block(text, min(1.0, linked / len(text)), node, flags))
            texts.clear()
        linked = 0

    def say(piece: str) -> None:
        nonlocal linked
        if piece and not stack.items[-1][3]:
            texts.append(piece)
            if in_link:
                linked += len(piece.strip())

    while m := OPEN.search(page, at):
        at = m.end()
        if m[2]:
            rest = None
            if at <= last_end:
                if ends is None:
                    found = REST.match(page, at)
                    if found:
                        rest, at = found[1], found.end()
                    else:
                        ends = TagEnds(page)
                if rest is None:
                    end = ends.after(at)
                    if end >= 0:
                        rest, at = page[at:end], end + 1
            if rest is None:
                continue  # no tag: its characters are text
        say(page[text_at : m.start()])
        if not m[2]:
            close = {"<!--": "-->", "<![CDATA[": "]]>"}.get(m[0], ">")
            end = page.find(close, at)
            if m[0] == "<![CDATA[":
                say(entities.escape(page[at:end] if end >= 0 else page[at:]))
            at = text_at = end + len(close) if end >= 0 else len(page)
            continue
        text_at = at
        name = m[2].lower()
        if m[1]:
            if name == "a":
                in_link = 0
            open_ = stack.last(name)
            if name not in INLINE and name not in WITHIN and not stack.items[open_ or -1][3]:
                flush()
            elif name == "br" and not stack.items[-1][3]:
                texts.append(" ")
            stack.close(name)
            continue
        if stack.items[-1][3]:
            pass  # inside an unseen element nothing ends a block
        elif name not in INLINE and name not in WITHIN:
            flush()
            in_link = 0
            if name in CLOSES or name not in VOID:
                stack.start(name)
        elif name == "br":
            texts.append(" ")
        if name in VOID or rest.endswith("/") and name not in HOLDERS:
            continue
        if name == "a":
            in_link = 1
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, at)
            at = text_at = end.end() if end else len(page)
            continue
        _, node, up, unseen = stack.items[-1]
        furniture, ambiguous, holds, content, hidden = _marks(rest)
        if name in ("body", "html"):
            furniture = ambiguous = holds = False
        article = up[0] or name in ("article", "main")
        flags = (
            article,
            up[1] or name in BOILER_TAGS,
            up[2] or name == "header" and not up[0],
            up[3] or furniture or ambiguous and not article,
            up[4] or ambiguous and article,
            up[5] or holds and not article,
            up[6] or holds and article,
            up[7] or content,
            up[8] or name in ("h1", "h2", "h3", "h4", "h5", "h6"),
            up[9] or name == "li",
            up[10] or hidden,
        )
        unseen = unseen or name in UNSEEN and not (name == "form" and holds_the_page(at))
        stack.push(name, node if name in INLINE or name in WITHIN else Node(node), flags, unseen)
    say(page[text_at:])
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    out = np.zeros((len(found), len(FEATURES)))
    for i, b in enumerate(found):
        article, tag, header, furniture, ambiguous, *names, heading, item, hidden = b.flags
        stop = b.text[-1] in ".!?…。"
        second = b.linked > 0.5 or not stop
        linked = b.linked if not article or ambiguous else 0.0
        out[i] = (1, article, tag, header, furniture, ambiguous and second, *names, linked, min(8.0, np.log1p(len(b.text))) - 3, stop, heading, item, hidden)
    return out


def train(pages: list[str]) -> np.ndarray:
    """Weights: the prior, moved by the pages' weakly labelled blocks."""
    xs, ys = [], []
    for page in pages:
        found = blocks(page)
        for b, x in zip(found, features(found), strict=True):
            article, tag, header, furniture, ambiguous = b.flags[:5]
            if ambiguous:
                continue  # no label
            if article or tag or header or furniture:
                xs.append(x)
                ys.append(float(article and not (tag or header or furniture)))
    w = PRIOR.copy()
    if not xs:
        return w
    x, y = np.array(xs), np.array(ys)
    weight = TRUST / len(y)  # all pages together weigh as TRUST blocks, so the prior stays for what they don't show
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = weight * x.T @ (p - y) + (w - PRIOR)
        curve = weight * (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        w = w - np.linalg.solve(curve, gradient)
    return w


def ties(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: the next block in page order, and the next one under the same parent."""
    out, last = [], {}
    for i, b in enumerate(found):
        if i:
            out.append((i - 1, i, TIE / (1 + apart(found[i - 1].node, b.node)) ** 2))
        parent = id(b.node.up or b.node)
        j = last.get(parent)
        if j is not None:
            out.append((j, i, TIE / 2))
        last[parent] = i
    return out


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise the sum of the costs of the terminals cut and the weights of the edges cut; True: the source's side."""
    n = len(odds)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0) + w
        near[b][a] = near[b].get(a, 0) + w
    odds, label = list(odds), [None] * n
    ready = [i for i in range(n) if abs(odds[i]) > sum(near[i].values())]
    while ready:
        i = ready.pop()
        if label[i] is not None:
            continue
        label[i] = odds[i] > 0
        for j, w in near[i].items():
            if label[j] is None:
                odds[j] += w if label[i] else -w
                del near[j][i]
                if abs(odds[j]) > sum(near[j].values()):
                    ready.append(j)
    gone = _pushed(odds, label, near)
    left = [i for i in range(n) if label[i] is None and i not in gone]
    if left:
        for i, side in zip(left, _max_flow(left, odds, near), strict=True):
            label[i] = side
    for i, (odd, around) in reversed(gone.items()):
        label[i] = odd + sum(w if label[j] else -w for j, w in around) > 0
    return label


def _pushed(odds: list[float], label: list[bool | None], near: list[dict[int, float]]) -> dict[int, tuple[float, list[tuple[int, float]]]]:
    """Pushes the flow of open nodes with two open neighbours or fewer on to these, one node after the other: what a node with ties v and w
    can pass is a change of its neighbours' own odds and a tie between them, so the cut stays minimal. Returns the nodes in order, with
    what their labels then depend on. Pages that are mostly rows of siblings are settled by this in linear time."""
    gone: dict[int, tuple[float, list[tuple[int, float]]]] = {}
    for i in range(len(odds)):
        if label[i] is None:
            near[i] = {j: w for j, w in near[i].items() if label[j] is None}
    ready = [i for i in range(len(odds)) if label[i] is None and len(near[i]) <= 2]
    while ready:
        i = ready.pop()
        if i in gone or len(near[i]) > 2:
            continue
        around = list(near[i].items())
        gone[i] = (odds[i], around)
        for j, _ in around:
            del near[j][i]
        (a, v), (b, w) = [*around, (-1, 0.0), (-1, 0.0)][:2]
        cost = {(x, y): min(v * x + w * y, v * (1 - x) + w * (1 - y) - odds[i]) for x in (0, 1) for y in (0, 1)}
        tie = max(0.0, (cost[1, 0] + cost[0, 1] - cost[0, 0] - cost[1, 1]) / 2)
        if a >= 0:
            odds[a] -= cost[1, 0] - cost[0, 0] - tie
        if b >= 0:
            odds[b] -= cost[0, 1] - cost[0, 0] - tie
            if tie > 0:
                near[a][b] = near[a].get(b, 0.0) + tie
                near[b][a] = near[b].get(a, 0.0) + tie
        ready += [j for j, _ in around if len(near[j]) <= 2]
    return gone


def _max_flow(left: list[int], odds: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Shortest augmenting paths; True: reachable from the source in the residual graph."""
    at = {x: k for k, x in enumerate(left)}
    source, sink = len(left), len(left) + 1
    room: list[dict[int, float]] = [{} for _ in range(sink + 1)]
    for x, k in at.items():
        if odds[x] > 0:
            room[source][k], room[k][source] = odds[x], 0.0
        elif odds[x] < 0:
            room[k][sink], room[sink][k] = -odds[x], 0.0
        for y, w in near[x].items():
            if y in at:
                room[k][at[y]] = w
    while True:
        came, queue = {source: source}, [source]
        for u in queue:
            for v, w in room[u].items():
                if w > 1e-12 and v not in came:
                    came[v] = u
                    queue.append(v)
        if sink not in came:
            return [k in came for k in range(len(left))]
        v, most = sink, float("inf")
        while v != source:
            most = min(most, room[came[v]][v])
            v = came[v]
        v = sink
        while v != source:
            room[came[v]][v] -= most
            room[v][came[v]] = room[v].get(came[v], 0.0) + most
            v = came[v]


def extract(page: str, weights: np.ndarray) -> str:
    found = blocks(page)
    if not found:
        return ""
    keep = minimum_cut((features(found) @ weights).tolist(), ties(found))
    return "\n\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract_pages(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(page_id, url, text, n_chars) for every row; the classifier is fitted on up to `sample` different pages of 100,000 characters at
    most, those with the smallest hashes: the hashes are found first, so no task sends more than its share of the sample."""
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    known = rows.where(F.length("html").between(1, 100_000)).select(F.xxhash64("html").alias("h"), "html")
    last = known.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    shown = known.where(F.col("h") <= F.lit(last)).groupBy("h").agg(F.min("html").alias("html")).orderBy("h").select("html")  # `sample` rows
    shared = pages.sparkSession.sparkContext.broadcast(train([r[0] for r in shown.collect()]))
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in slices(batches, "html"):
            texts = [extract(x or "", weights) for x in column(batch, "html").to_pylist()]
            yield typed([column(batch, "page_id"), column(batch, "url"), texts, list(map(len, texts))], kinds)

    rows = rows.withColumn("page_id", F.col("page_id").cast("long")).withColumn("url", F.col("url").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
