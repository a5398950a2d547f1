"""Main text of HTML pages by tree scoring.

A page becomes a tree of elements with text (raw text elements and comments left out; open
paragraphs, list items, cells and the like end where HTML has them end). Elements that are page
furniture by tag, role or name (menus, headers, footers, side bars, notices, adverts, forms, reader
comments) are cut. A name is that of a whole class or id: ``no-sidebar`` or ``comments-enabled`` say
how a page is laid out, and an element that holds an ``article`` or ``main`` is never furniture by
name. Neither is a form that holds over half of the page's text that is not link text, nor a block of
such size whose name is doubtful (notice, alert, header, ...; comments and menus are never in doubt).

Each paragraph (the text that stands directly in a block, or between line breaks in a container) has
points: one, one for each comma, and up to three for length, less its share of link text. It passes
them to its container, half of them one element up, and ever smaller shares further up. A
container's score is discounted by the link density of all its text. The best container is kept with
what stands beside it, elements and bare text, unless that is mostly links; a container inside an
``article`` or ``main`` element stands for that whole element. Containers elsewhere that have at least
half of its score are parts of the same text (rows of columns, several articles): what is kept then
stands below the element that holds them all.

The text is that of the blocks in page order: white space inside a block is one space, blocks are
joined by one space, character references are decoded.

A page takes time in proportion to its length: sizes, links and commas of all elements are summed in
one walk from the leaves up, open elements are found by the places of their tags on the stack, and
a tag that never ends makes the rest of its page be read with simpler tag ends.

Defined results: null or empty html, or a page of furniture alone, has an empty text. A page without
scored containers gives what text its body has outside furniture. Rows are pages, also where ids
repeat or are null. Columns but id, url and html are not read, and may have any names.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.llm.common import by_batch

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul xmp".split()
)
#: Start tags that end an open element, and the elements that it cannot be ended through.
P_ENDERS = BLOCKS - frozenset("body html td th tr tbody thead tfoot li dd dt option optgroup caption legend".split())
ENDS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
WALLS = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",), "tbody": ("table",), "tfoot": ("table",)}
#: Blocks of which each is one paragraph; in other blocks text between line breaks is one.
PARAGRAPHS = frozenset("address blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre summary td th xmp".split())
#: Page furniture.
FURNITURE = frozenset("nav header footer aside form button select dialog menu fieldset search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promos promotion promotions banner cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription paywall comment comments commentlist disqus respond replies nav navbar navigation menu menus breadcrumb breadcrumbs header masthead footer sidebar widget widgets related recommended recommendations share sharing social login signup search toolbar pagination pager skiplink hidden".split()
)
#: Names among these that others give to what a page is about.
DOUBTFUL = frozenset("notice notices alert alerts banner header masthead hidden overlay modal popup widget widgets promo promos promotion promotions".split())
#: Words that make a class say what a page has, allows or lacks.
SETTINGS = frozenset("no not has have with without is enabled disabled open opened closed on off allow allowed fixed sticky layout".split())
NEVER_NAMED = frozenset("html body article main p h1".split())

TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"=\s*([\"'])|>")
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Shares of a paragraph's points that its container and the elements above it get.
SHARES = (1.0, 1 / 2, 1 / 6, 1 / 9, 1 / 12)


class Node:
    __slots__ = ("tag", "parent", "children", "named", "cut", "linked", "size", "links", "commas", "score")

    def __init__(self, tag: str, parent: Node | None, cut: bool, named: int):
        self.tag, self.parent, self.cut, self.named = tag, parent, cut, named
        self.linked = tag == "a" or parent is not None and parent.linked
        self.children: list[Node | str] = []
        self.size = self.links = self.commas = 0
        self.score = 0.0

    def density(self) -> float:
        return self.links / self.size if self.size else 0.0


def names_furniture(value: str) -> int:
    """Whether one of the names in a class or id is that of page furniture: 1 if only in doubt, 2 if so."""
    found = 0
    for name in value.split():
        words = {w.lower() for w in WORD.findall(name)}
        if (words & NAMES or {"side", "bar"} <= words or {"skip", "link"} <= words) and not words & SETTINGS:
            found = max(found, 1 if words & NAMES and words & NAMES <= DOUBTFUL else 2)
    return found


def furniture(tag: str, attributes: str) -> tuple[bool, int]:
    """Whether an element is furniture by tag, role or state, and whether by its names."""
    cut, named = tag in FURNITURE or tag == "annotation", 0
    if attributes and tag not in NEVER_NAMED:
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id"):
                named = max(named, names_furniture(value))
            cut |= name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true"
    return cut, named


class Parser:
    """The elements of a page in page order; ``nodes[0]`` is the root."""

    def __init__(self, page: str):
        self.page, self.loose, self.gone = page, False, set()
        self.nodes = [Node("#root", None, False, 0)]
        self.stack = [self.nodes[0]]
        self.places: dict[str, list[int]] = {}  # of each tag on the stack
        self.solid: list[int] = []  # of blocks other than p
        self.blocks: list[int] = []
        self.parse()

    def tag_end(self, at: int) -> int:
        """Where the tag whose name ends at ``at`` ends; -1 where no sign ends it."""
        start = at
        while not self.loose:
            m = STOP.search(self.page, at)
            if m is None:
                self.loose = True
                break
            if m[1] is None:
                return m.start()
            close = -1 if m[1] in self.gone else self.page.find(m[1], m.end())
            if close < 0:  # a quote that nothing closes is an ordinary sign
                self.gone.add(m[1])
            at = m.end() if close < 0 else close + 1
        return self.page.find(">", start)

    def push(self, node: Node) -> None:
        for places in (self.places.setdefault(node.tag, []), self.solid if node.tag in BLOCKS and node.tag != "p" else None, self.blocks if node.tag in BLOCKS else None):
            if places is not None:
                places.append(len(self.stack))
        self.stack.append(node)

    def cut_at(self, place: int) -> None:
        """Ends the open elements from this place of the stack on."""
        while len(self.stack) > place:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            for places in (self.solid, self.blocks):
                if places and places[-1] == len(self.stack):
                    places.pop()

    def wall(self, tags: tuple) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, tags: tuple, wall: int) -> None:
        """Ends the outermost open element of ``tags`` beyond a wall."""
        firsts = [own[i] for t in tags if (own := self.places.get(t)) and (i := bisect_right(own, wall)) < len(own)]
        if firsts:
            self.cut_at(min(firsts))

    def text(self, text: str) -> None:
        if text:
            self.stack[-1].children.append(text)

    def parse(self) -> None:
        page, pos, size, last = self.page, 0, len(self.page), self.page.rfind(">")
        while pos < size:
            at = page.find("<", pos)
            if at < 0 or at > last:
                self.text(page[pos:])
                break
            m = TAG.match(page, at)
            if m is None and page[at + 1 : at + 2] not in ("!", "?", "/"):
                self.text(page[pos : at + 1])  # a lone sign
                pos = at + 1
                continue
            self.text(page[pos:at])
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                pos = size if end < 0 else end + 3
                continue
            if m is None:
                pos = page.find(">", at) + 1
                continue
            end = self.tag_end(m.end())
            pos, tag, attributes = end + 1, m[1].lower(), page[m.end() : end]
            if page[at + 1] == "/":
                self.end(tag)
            elif tag in RAW and not attributes.rstrip().endswith("/"):
                found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, pos)
                pos = found.end() if found else size
            else:
                self.start(tag, attributes)
                if tag == "xmp":  # its content is text as it stands
                    stop = re.compile("</xmp", re.I).search(page, pos)
                    stop = stop.start() if stop else size
                    self.text(html.escape(page[pos:stop], False))
                    pos = stop

    def start(self, tag: str, attributes: str) -> None:
        if tag in P_ENDERS:
            self.close(("p",), self.solid[-1] if self.solid else 0)
        if tag in ENDS:
            self.close(ENDS[tag], self.wall(WALLS[tag]))
        cut, named = furniture(tag, attributes)
        node = Node(tag, self.stack[-1], cut, named)
        self.stack[-1].children.append(node)
        self.nodes.append(node)
        if tag not in VOID and not (attributes.rstrip().endswith("/") and tag not in BLOCKS):
            self.push(node)

    def end(self, tag: str) -> None:
        own = self.places.get(tag)
        if not own or own[-1] < self.wall(WALLS.get(tag, ())):
            return
        if tag not in BLOCKS and self.blocks and self.blocks[-1] > own[-1]:
            return  # an inline element would close blocks that hold it open
        self.cut_at(own[-1])


#: Elements that hold whole pages now and then, though they are furniture by tag.
WHOLE = frozenset("form fieldset".split())


def holds_most(nodes: list[Node]) -> set[int]:
    """Nodes that hold over half of the page's text that is not link text."""
    sizes: dict[int, int] = {}
    for node in reversed(nodes):
        own = 0 if node.linked else sum(len(t.strip()) for t in node.children if isinstance(t, str))
        sizes[id(node)] = sizes.get(id(node), 0) + own
        if node.parent is not None:
            sizes[id(node.parent)] = sizes.get(id(node.parent), 0) + sizes[id(node)]
    return {n for n, size in sizes.items() if 2 * size > sizes[id(nodes[0])]}


def settle(nodes: list[Node], by_name: bool) -> None:
    """Marks what is cut: furniture by tag, and by name what does not hold the article, or most of the
    page. An article's own header with its title stays."""
    holds: set[int] = set()
    titled: set[int] = set()
    for node in reversed(nodes):
        if node.parent is not None:
            if node.tag in ("article", "main") or id(node) in holds:
                holds.add(id(node.parent))
            if node.tag == "h1" or id(node) in titled:
                titled.add(id(node.parent))
    within, most = set(), holds_most(nodes)
    for node in nodes:
        if node.tag in ("article", "main") or node.parent is not None and id(node.parent) in within:
            within.add(id(node))
        if node.tag == "header" and id(node) in titled and id(node) in within or node.tag in WHOLE and (id(node) in most or id(node) in holds):
            node.cut = False
        if by_name and node.named and id(node) not in holds and not (node.named == 1 and id(node) in most):
            node.cut = True


def kept_nodes(nodes: list[Node]) -> list[Node]:
    """All nodes, in page order, that are in no cut element."""
    kept, gone = [], set()
    for node in nodes:
        if node.cut or node.parent is not None and id(node.parent) in gone:
            gone.add(id(node))
        else:
            kept.append(node)
    return kept


def paragraphs(node: Node, owner: dict[int, Node]) -> None:
    """Gives each inline element the block that its text stands in."""
    owner[id(node)] = node if node.tag in BLOCKS or node.parent is None else owner[id(node.parent)]


def score(nodes: list[Node]) -> list[Node]:
    """Sums sizes, links and commas, and scores containers; returns those with a score."""
    owner: dict[int, Node] = {}
    runs: dict[int, list[list[int]]] = {}  # of each block: size, links and commas of each stretch of text
    for node in nodes:
        paragraphs(node, owner)
        block = owner[id(node)]
        if node.tag == "br" and block.tag not in PARAGRAPHS:
            runs.setdefault(id(block), []).append([0, 0, 0])
        elif block is node and node.parent is not None and node.tag not in PARAGRAPHS:
            runs.setdefault(id(node), []).append([0, 0, 0])
        for text in node.children:
            if isinstance(text, str) and (n := len(text.strip())):
                own = runs.setdefault(id(block), [])
                if not own:
                    own.append([0, 0, 0])
                for i, x in enumerate((n, n if node.linked else 0, text.count(","))):
                    own[-1][i] += x
                node.size, node.links, node.commas = node.size + n, node.links + (n if node.linked else 0), node.commas + text.count(",")
    scored: dict[int, Node] = {}
    for node in nodes:
        if owner[id(node)] is not node:
            continue
        container = node.parent if node.tag in PARAGRAPHS else node
        for size, links, commas in runs.get(id(node), ()):
            if size and container is not None:
                points, at = (1 + commas + min(size / 100, 3)) * (1 - links / size), container
                for share in SHARES:
                    if at is None:
                        break
                    at.score += points * share
                    scored[id(at)] = at
                    at = at.parent
    for node in reversed(nodes):
        if node.parent is not None:
            up = node.parent
            up.size, up.links, up.commas = up.size + node.size, up.links + node.links, up.commas + node.commas
    for node in scored.values():
        node.score *= 1 - node.density()
    return [n for n in nodes if id(n) in scored]


def path_of(node: Node) -> list[Node]:
    """The node and all above it, from the root down."""
    path = []
    while node is not None:
        path.append(node)
        node = node.parent
    return path[::-1]


def whole_article(best: Node) -> Node:
    """The outermost ``article`` or ``main`` that a container is in, or itself."""
    return next((n for n in path_of(best) if n.tag in ("article", "main")), best)


def main_nodes(nodes: list[Node]) -> list[Node | str]:
    """What of the tree is kept, in page order."""
    scored = score(nodes)
    if not scored:
        return [nodes[0]]
    first = max(scored, key=lambda n: n.score)  # the first in page order of the best
    best = whole_article(first)
    # containers apart from the best one that score at least half as much: parts of the same text
    above, within = {id(n) for n in path_of(best)}, {id(best)}
    common = path_of(best)
    for node in nodes:
        if node.parent is not None and id(node.parent) in within:
            within.add(id(node))
    for node in scored:
        if 2 * node.score >= first.score and id(node) not in above and id(node) not in within:
            other = {id(n) for n in path_of(node)}
            common = [n for n in common if id(n) in other]
    if common[-1] is not best:
        return [c for c in common[-1].children if isinstance(c, str) or not c.cut and (c.tag == "br" or c.density() < 0.5)]
    if best.parent is None or best.tag in ("article", "main", "body"):
        return [best]
    kept: list[Node | str] = []
    for beside in best.parent.children:
        if isinstance(beside, str) or beside is best or not beside.cut and (beside.tag == "br" or beside.density() < 0.5):
            kept.append(beside)
    return kept


def walk(node: Node | str) -> Iterator[tuple[Node | str, bool]]:
    """Elements and texts in page order without what is cut; an element comes once more when it ends."""
    stack: list[tuple[Node | str, bool]] = [(node, True)]
    while stack:
        item, begins = stack.pop()
        yield item, begins
        if begins and not isinstance(item, str):
            stack.append((item, False))
            stack += [(c, True) for c in reversed(item.children) if isinstance(c, str) or not c.cut]


def blocks(kept: list[Node | str]) -> list[str]:
    """The text of each block, clean."""
    out: list[str] = []
    part: list[str] = []
    for one in kept:
        for item, _ in walk(one):
            if isinstance(item, str):
                part.append(item)
            elif item.tag in BLOCKS:
                out.append("".join(part))
                part = []
            elif item.tag == "br":
                part.append(" ")
    out.append("".join(part))
    return [t for t in (" ".join(html.unescape(b).split()) for b in out) if t]


def main_text(page: str) -> str:
    if not page:
        return ""
    for by_name in (True, False):
        nodes = Parser(page).nodes
        settle(nodes, by_name)
        text = " ".join(blocks(main_nodes(kept_nodes(nodes))))
        if text or not any(n.named for n in nodes):
            break
    return text


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: ``page_id, url, text, n_chars``."""

    def columns(batch: pa.RecordBatch) -> list:
        return [batch.column(0), batch.column(1), [main_text(p.as_py()) for p in batch.column(2)]]

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
    return rows.mapInArrow(by_batch(columns, schema), "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
