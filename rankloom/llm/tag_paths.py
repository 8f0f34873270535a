"""HTML extraction (operator 5): main text by tag-path ratios.

A page becomes its text blocks in order, each with the tag path from the root to it. A path's text
ratio is its characters per block and its punctuation ratio the marks per block; their product, damped by the share of link text, is
fused with its smoothed value over neighbouring blocks. Blocks whose value reaches a share of the page's spread are content.

Elements that never hold an article's text (menus, forms, scripts, adverts and the like, by tag, role or class) are out, and so are sections under a heading
such as "Comments" and articles that are a small part of another one. A class is overruled by an article inside or, where no article is elsewhere, by most of the page's text; within an article
the class of a tool ("search", "social") is overruled when content blocks make up the element.

The container of the content decides which of the remaining blocks, such as a title or a one-word paragraph, belong to it: the article (with its siblings that hold content)
or main element that holds most of the content; where none does, the common ancestor of the content outside of such small articles, of which only paths that are mostly links are left out.

One page is one row, parsed in one go by an Arrow batch function; there is no shuffle. Time and memory grow with the page, not with its depth: an
element knows its parent and the last element inside it, and open elements are found by tag.
"""

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import slices, whole_texts

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("head title script style noscript template nav footer aside form button select textarea iframe object svg canvas menu dialog audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription sidebar widget widgets related recommended recommendations share sharing social comment comments commentlist respond reply replies disqus menu nav navbar navigation "
    "breadcrumb breadcrumbs header masthead topbar footer login signin signup search pagination pager skip hidden".split())
#: Parts that turn the rest of a class around: "no-sidebar" and "category-notices" name no sidebar and no notice.
STATES = frozenset("no not has have with without is hide show category cat tag format type status".split())
#: Words that only say where a box is or what it is made of: "comments-area", "ad-slot" and "cookie-bar" name a box as the bare word does.
BOXES = frozenset("area list slot container box bar left right top bottom thread wrapper wrap inner outer block section panel unit item items group holder zone column col rail primary secondary main".split())
#: Names of tools that a text may also be about; within an article its content overrules them.
TOOLS = frozenset("search pagination pager social share sharing skip login signin signup menu nav navbar navigation breadcrumb breadcrumbs".split())
REMARKS = frozenset("comment comments commentlist respond reply replies disqus".split())
REMARK_HEAD = re.compile(r"(?:\d+ )?(?:reader |user |your )?(?:comments?|replies|responses|discussion|leave a (?:comment|reply)|join the (?:conversation|discussion))(?: ?\(\d+\))?:?", re.I)
HOLDERS = ("article", "main")
#: Elements that a new one of the same group ends.
ENDED_BY = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
LIST_BORDER = frozenset("ul ol dl table".split())
#: Elements of a list or table, and those that hold one block of text: they stand in a container and are none.
PIECES = frozenset("ul ol dl table thead tbody tfoot tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = HEADINGS | {"p"}
LEAVES = frozenset("p li dt dd td th h1 h2 h3 h4 h5 h6 pre blockquote caption figure figcaption".split())
MARKS = re.compile(r"[.,;:!?…。，、；：！？।؟«»\"“”()]")
WHITE = re.compile(r"\s+")
CUT_TAG = re.compile(r"<(?:[a-zA-Z/!?][^<>]*)?$")
#: Kernel over neighbouring blocks, weight of the smoothed value, and the share of the spread that makes content.
KERNEL = np.exp(-0.5 * (np.arange(-2, 3) / 1.0) ** 2)
FUSED, SPREAD_SHARE = 0.5, 0.3


class _Blocks(HTMLParser):
    """A page's elements in the order they open (number 0 is the page) and its blocks (element, text, characters within links)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.parent, self.path, self.out = ["#root"], [0], [0], [False]
        self.known = {}  # (path of the parent, tag): path
        self.open = [0]
        self.at = defaultdict(list)  # tag: its places among the open elements
        self.borders, self.solid = [], [0]  # places of open lists and tables; of all but paragraphs and headings
        self.named = {}  # element: (tag, the names in its classes, whether they name it for sure)
        self.holding = set()  # elements with an article or main inside
        self.within = {}  # article or main: the article around it
        self.parts, self.link_chars, self.links = [], 0, 0
        self.blocks = []

    def flush(self):
        if self.parts:
            text = WHITE.sub(" ", "".join(self.parts)).strip()
            if text and not self.out[self.open[-1]]:
                self.blocks.append((self.open[-1], text, min(self.link_chars, len(text))))
        self.parts, self.link_chars = [], 0

    def _pop(self, place):
        self.flush()
        while len(self.open) > place:
            self.at[self.tags[self.open.pop()]].pop()
        for places in (self.borders, self.solid):
            while places and places[-1] >= place:
                places.pop()

    def handle_starttag(self, tag, attrs):
        if tag in INLINE:
            self.links += tag == "a"
            return
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            elif tag == "hr":
                self.flush()
            return
        if self.at["p"] and self.at["p"][-1] > self.solid[-1]:  # a block ends an open paragraph
            self._pop(self.at["p"][-1])
        if tag in ENDED_BY:
            place = max((self.at[t][-1] for t in ENDED_BY[tag].split() if self.at[t]), default=0)
            if place > (self.borders[-1] if self.borders else 0):
                self._pop(place)
        self.flush()
        self.links = 0
        got, new, above = dict(attrs), len(self.tags), self.open[-1]
        self.tags.append(tag)
        self.parent.append(above)
        self.path.append(self.known.setdefault((self.path[above], tag), len(self.known) + 1))
        self.out.append(self.out[above] or self._never(tag, got))
        if not self.out[new]:
            self._names(new, tag, got)
        place = len(self.open)
        self.open.append(new)
        self.at[tag].append(place)
        if tag in LIST_BORDER:
            self.borders.append(place)
        if tag not in PARAGRAPHS:
            self.solid.append(place)

    def _never(self, tag, got):
        if tag in NEVER or tag == "header" and not (self.at["article"] or self.at["main"]):
            return True
        return "hidden" in got or (got.get("aria-hidden") or "") == "true" or (got.get("role") or "").lower() in ROLES

    def _names(self, new, tag, got):
        """Notes an element that its classes or id name; the whole page decides later."""
        label = f"{got.get('class') or ''} {got.get('id') or ''}".lower().split()
        if tag in HOLDERS and not self.at["article"]:
            for e in reversed(self.open):
                if e in self.holding:
                    break
                self.holding.add(e)
        elif tag == "article":  # an article within an article is a comment or a teaser
            self.within[new] = self.open[self.at["article"][0]]
        if not label or tag in ("html", "body", "main") or tag == "article" and not self.at["article"]:
            return
        held = bool(self.at["article"] or self.at["main"])
        sure, maybe = set(), set()
        for token in label:
            parts = [w for w in re.split(r"[^a-z]+", token) if w]
            found = {w for w in parts if w in NAMES and not (held and w == "header")}
            if not found or STATES.intersection(parts):
                continue
            # the last part is what a class names ("reader-comments"), but for words of boxes; a header of something ("post-header") is a part of it
            boxed = found.union(BOXES).issuperset(parts)
            (sure if boxed or parts[-1] in found and parts[-1] != "header" and tag != "article" else maybe).update(found)
        if sure or maybe and tag != "article":
            self.named[new] = (tag, frozenset(sure or maybe), bool(sure), held)

    def handle_endtag(self, tag):
        if tag in INLINE:
            self.links = max(0, self.links - (tag == "a"))
        elif tag in VOID:
            if tag == "br":
                self.parts.append(" ")
        elif self.at[tag]:
            self._pop(self.at[tag][-1])
        elif tag == "p":
            self.flush()

    def handle_data(self, data):
        self.parts.append(data)
        if self.links:
            self.link_chars += len(data)


class _Page:
    """A parsed page: sums over elements and their insides, and the last element inside each."""

    def __init__(self, html: str):
        p = _Blocks()
        p.feed(CUT_TAG.sub("", html))
        p.close()
        p.flush()
        self.p, self.tags, self.parent, self.blocks = p, p.tags, p.parent, p.blocks
        self.last = list(range(len(self.tags)))
        for e in range(len(self.tags) - 1, 0, -1):
            self.last[self.parent[e]] = max(self.last[self.parent[e]], self.last[e])

    def sums(self, amounts) -> list[int]:
        """For every element, the sum of the amounts of the blocks inside."""
        out = [0] * len(self.tags)
        for (e, _, _), x in zip(self.blocks, amounts):
            out[e] += x
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out

    def inside(self, elements) -> list[bool]:
        """For every element, whether it is or lies in one of the given ones."""
        out = [False] * len(self.tags)
        for e in range(len(out)):
            out[e] = e in elements or e > 0 and out[self.parent[e]]
        return out

    def keep(self, flags) -> None:
        self.blocks = [b for b, ok in zip(self.blocks, flags) if ok]


def block_values(paths: list[int], sizes: list[int], marks: list[int], linked: list[int], fused: float = FUSED) -> np.ndarray:
    """The fused value of every block, from its path, characters, punctuation marks and characters within links; ``fused`` is the weight of the smoothed one."""
    _, at, count = np.unique(np.asarray(paths, dtype=np.int64), return_inverse=True, return_counts=True)
    total, mark, link = (np.bincount(at, weights=np.asarray(x, dtype=float)) for x in (sizes, marks, linked))
    own = (total / count * (1 + mark / count) * (1 - link / total))[at]
    near = np.convolve(np.pad(own, 2, mode="edge"), KERNEL / KERNEL.sum(), mode="valid")
    return (1 - fused) * own + fused * near


def _content(page: _Page, fused: float = FUSED) -> list[bool]:
    """Whether each block's value reaches the share of the spread that makes content."""
    values = block_values([page.p.path[e] for e, _, _ in page.blocks], [len(t) for _, t, _ in page.blocks], [len(MARKS.findall(t)) for _, t, _ in page.blocks], [n for _, _, n in page.blocks], fused)
    return (values >= SPREAD_SHARE * values.std()).tolist()


def _boxes(page: _Page) -> set[int]:
    """The elements that are out by their names, by a heading over comments, or as small articles within an article."""
    chars, links = page.sums(len(t) for _, t, _ in page.blocks), page.sums(n for _, _, n in page.blocks)
    total, named, holding = chars[0], page.p.named, page.p.holding
    out = set()
    if named:
        told = page.sums(len(t) if ok else 0 for (_, t, _), ok in zip(page.blocks, _content(page, 0)))  # by its own path: text beside it says nothing
        of_kind, linked, around = defaultdict(int), defaultdict(int), [0] * len(page.tags)
        for e in range(1, len(page.tags)):
            above = page.parent[e]
            around[e] = above if above in named else around[above]
            if e in named and named.get(around[e]) != named[e]:  # elements of one kind count together
                of_kind[named[e]] += chars[e]
                linked[named[e]] += links[e]
        holders = [e for e, t in enumerate(page.tags) if t in HOLDERS and not page.p.out[e]]
        for e, kind in named.items():
            _, names, sure, held = kind
            if e in holding or not chars[e]:
                continue
            if not sure:
                gone = 2 * links[e] >= chars[e]
            elif held and names <= TOOLS and 2 * told[e] >= chars[e] > 2 * links[e]:
                gone = False
            elif not held and any(chars[h] for h in holders):  # no need to take a named box for the text
                gone = True
            elif names <= REMARKS:
                gone = 5 * of_kind[kind] <= 4 * total
            else:
                gone = 2 * of_kind[kind] <= total or 2 * linked[kind] >= of_kind[kind]
            if gone:
                out.add(e)
    for e, text, _ in page.blocks:
        if page.tags[e] in HEADINGS and len(text) < 60 and REMARK_HEAD.fullmatch(text):
            box = page.parent[e]
            while box and chars[box] == len(text) and page.tags[box] in ("div", "section"):
                box = page.parent[box]
            if page.tags[box] in ("div", "section", "ol", "ul") and box not in holding and 2 * chars[box] <= total:
                out.add(box)
    nested = defaultdict(int)
    for e, outer in page.p.within.items():
        if page.parent[e] not in page.p.within:
            nested[outer] += chars[e]
    return out | {e for e, outer in page.p.within.items() if 2 * nested[outer] < chars[outer]}


def main_text(html: str | None) -> str:
    """The page's main text, blocks joined by line ends; empty for a null, an empty page, or one without content."""
    if not html:
        return ""
    page = _Page(html)
    if page.blocks and (boxes := _boxes(page)):
        gone = page.inside(boxes)
        page.keep([not gone[e] for e, _, _ in page.blocks])
    if not page.blocks:
        return ""
    content = _content(page)
    weight = page.sums(len(t) if ok else 0 for (_, t, _), ok in zip(page.blocks, content))
    for kind in HOLDERS:
        holders = _holders(page, content, weight, kind)
        if holders and 2 * sum(weight[e] for e in holders) >= weight[0]:
            held = page.inside(holders)
            return "\n".join(text for e, text, _ in page.blocks if held[e])
        if holders and kind == "article":  # small articles beside the text are teasers
            small = page.inside({e for e, t in enumerate(page.tags) if t == kind})
            content = [ok and not small[e] for (e, _, _), ok in zip(page.blocks, content)]
            weight = page.sums(len(t) if ok else 0 for (_, t, _), ok in zip(page.blocks, content))
            if not weight[0]:
                content = [True] * len(page.blocks)
    dense = _link_dense(page)
    top = _container(page, [e for (e, _, _), ok, d in zip(page.blocks, content, dense) if ok and not d])
    return "\n".join(text for (e, text, _), d in zip(page.blocks, dense) if not d and top <= e <= page.last[top])


def _holders(page: _Page, content: list[bool], weight: list[int], kind: str) -> set[int]:
    """The outermost element of a kind with most content, and its siblings of that kind that hold content other than links."""
    own = page.inside({e for e, t in enumerate(page.tags) if t == kind})
    found = [e for e, t in enumerate(page.tags) if t == kind and weight[e] and not own[page.parent[e]]]
    if not found:
        return set()
    best = max(found, key=lambda e: (weight[e], -e))
    told = page.sums(int(ok and 2 * n < len(t)) for (_, t, n), ok in zip(page.blocks, content))
    return {best} | {e for e in found if told[e] and page.parent[e] == page.parent[best]}


def _link_dense(page: _Page) -> list[bool]:
    """Whether a block's path is mostly links, within its own list, table or section.

    A menu and a list of the text may have the same tags, so a list or table is judged by itself; elsewhere the path of the whole page must be
    dense too. Where no block is left the page is made of links, and none is dense.
    """
    top = list(range(len(page.tags)))
    for e in range(1, len(top)):
        if page.tags[e] in PIECES and page.tags[page.parent[e]] in PIECES:
            top[e] = top[page.parent[e]]
    chars, links, group = defaultdict(int), defaultdict(int), []
    for e, text, linked in page.blocks:
        inside = top[page.parent[e]]
        group.append((inside, 0 if page.tags[inside] in PIECES else page.p.path[e] + 1))
        for g in {group[-1], (-1, page.p.path[e])}:
            chars[g] += len(text)
            links[g] += linked
    dense = [(not g[1] or 2 * links[-1, g[1] - 1] >= chars[-1, g[1] - 1]) and 2 * links[g] >= chars[g] for g in group]
    return [False] * len(dense) if all(dense) else dense


def _container(page: _Page, chosen: list[int]) -> int:
    """The deepest element around all content blocks; a list, a table or a single block is no container."""
    if not chosen:
        return 0
    top, end, whole = min(chosen), max(chosen), set(chosen)
    while page.last[top] < end:
        top = page.parent[top]
    while top and (page.tags[top] in PIECES or top in whole and page.tags[top] in LEAVES):
        top = page.parent[top]
    return top


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row; repeated rows are extracted alike, an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html", 1 << 20):
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return whole_texts(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
