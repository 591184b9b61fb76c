"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas on to the elements around them, less the further out; an element's
points are discounted by its share of link text. The best element is the article's container; siblings with points or
prose of their own are kept with it. Menus, notices, comments and the like are cut before, by their names and by what
they hold: a name alone never cuts what holds nearly all of the page's prose.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckloom.llm.common import table

# Element names of HTML, by how they are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(
    "script style noscript template head button select textarea input label iframe object embed svg canvas audio video".split()
)
ASIDE = frozenset("nav footer aside form fieldset dialog menu".split())
BLOCK = frozenset(
    "address article blockquote body center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hgroup html "
    "li main ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd div section article main body".split())
#: Start tags that end an open element: name -> what it ends, and what that is looked for within.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Words of class names and ids of what is not article text, and of what is.
UNLIKELY = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox adslot sponsor sponsored promo promotion banner cookie "
    "cookies consent gdpr notice notices alert nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidenav rail "
    "footer foot masthead topbar toolbar comment comments commentlist disqus reply replies respond discussion social share "
    "sharing newsletter subscribe signup login modal popup overlay related recommended recommendations widget pagination "
    "pager skip search tags".split()
)
LIKELY = frozenset("article body content entry main post story text".split())
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
#: Words that name a part of the thing that the word before them names, and words that say what a thing has or lacks.
PARTS = frozenset(
    "container wrapper wrap box inner outer list item items area section block panel slot links link left right top bottom "
    "primary secondary holder bar row col column columns group unit form posts articles stories buttons button icons icon title "
    "header body content text main media".split()
)
QUALIFIERS = frozenset("no not without with has have hide show".split())
#: Of an element with such a class of its own, another class name doesn't say that it is unlikely.
OWN_LIKELY = LIKELY - PARTS
UNLIKELY_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
_NAME_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")

#: A paragraph shorter than this passes no points; one of the named length or more is kept beside the container.
LEAST_CHARS, PROSE_CHARS = 25, 80


def _names(attrs: dict) -> Iterator[list[str]]:
    """The words of each class name and of the id, but for those that say what the element has or lacks."""
    for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
        words = [w.lower() for w in _NAME_WORD.findall(name)]
        if words and words[0] not in QUALIFIERS:
            yield words


def _thing(words: list[str]) -> str:
    """What a compound name names: its last word that isn't a part of something (``post-comments``, ``sidebar-left``)."""
    return next((w for w in reversed(words) if w not in PARTS), words[-1])


class Node:
    __slots__ = ("name", "attrs", "parent", "in_article", "items", "points", "chars", "linked", "own", "kind", "things", "prose", "titled")

    def __init__(self, name: str, attrs: dict, parent: Node | None):
        self.name, self.attrs, self.parent = name, attrs, parent
        self.in_article = parent is not None and (parent.in_article or parent.name in ("article", "main"))
        self.items: list[Node | str] = []
        self.points = 0.0
        # letters inside, letters inside links, and the text of its own paragraph, if it is one
        self.chars = self.linked = 0
        self.own: list[str] | str = []
        self.things = {_thing(words) for words in _names(attrs)}
        self.kind = self._kind()
        # letters of paragraphs inside, without links and comments; whether a title or an article is inside
        self.prose, self.titled = 0, name in ("h1", "article", "main")

    def _kind(self) -> str:
        """``never`` for what isn't shown or isn't text, ``comments``, ``aside`` for what names say is beside an article,
        ``maybe`` for what they only hint at, else empty."""
        a = self.attrs
        style = "".join((a.get("style") or "").lower().split())
        if self.name in DROPPED or "hidden" in a or (a.get("aria-hidden") or "").lower() == "true":
            return "never"
        if "display:none" in style or "visibility:hidden" in style:
            return "never"
        if self.things & COMMENTS:
            return "comments"
        if self.name in ("html", "body", "article", "main"):
            return ""
        if self.name in ASIDE or (a.get("role") or "").lower() in UNLIKELY_ROLES or self.name == "header" and not self.in_article:
            return "aside"
        if self.things & UNLIKELY:
            return "" if self.things & OWN_LIKELY else "aside"
        return "maybe" if any(w in UNLIKELY for words in _names(a) for w in words) else ""

    def likely(self) -> bool:
        return bool(self.things & LIKELY)

    def above(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def walk(self) -> Iterator[tuple[Node, str | None]]:
        """Every element and every piece of text in page order: (element, None), (its element, text)."""
        stack: list[tuple[Node, Iterator]] = [(self, iter(self.items))]
        yield self, None
        while stack:
            node, left = stack[-1]
            for x in left:
                if isinstance(x, str):
                    yield node, x
                else:
                    yield x, None
                    stack.append((x, iter(x.items)))
                    break
            else:
                stack.pop()


class Tree(HTMLParser):
    """Builds the element tree, closing what HTML closes implicitly.

    ``path`` holds the open elements. For each name the depths of those open are kept, and for block elements but p, so
    what an end tag ends is found without a walk, however deep the page.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {}, None)
        self.path, self.depths, self.block_depths = [self.root], {}, []

    def _deepest(self, names: set | frozenset) -> int:
        return max((self.depths[n][-1] for n in names if self.depths.get(n)), default=0)

    def _end(self, names: set | frozenset, within: set | frozenset = frozenset(), block: bool = False, p: bool = True) -> None:
        """Close the innermost open element of those names, unless one of ``within`` lies between, or, with ``block``, a
        block element (p only if it is to count)."""
        depth, limit = self._deepest(names), self._deepest(within)
        if block:
            limit = max(limit, self.block_depths[-1] if self.block_depths else 0, self._deepest({"p"}) if p else 0)
        if depth > limit:
            self._cut(depth)

    def _cut(self, depth: int) -> None:
        while len(self.path) > depth:
            node = self.path.pop()
            self.depths[node.name].pop()
            if node.name in BLOCK and node.name != "p":
                self.block_depths.pop()

    def handle_starttag(self, name: str, attrs: list) -> None:
        if name in ("html", "body"):
            self._end({"head"})
            return
        if name in CLOSES:
            self._end(*CLOSES[name])
        elif name in BLOCK:
            self._end({"p"}, block=True, p=False)
        node = Node(name, dict(attrs), self.path[-1])
        self.path[-1].items.append(node)
        if name not in VOID:
            self.depths.setdefault(name, []).append(len(self.path))
            if name in BLOCK and name != "p":
                self.block_depths.append(len(self.path))
            self.path.append(node)

    def handle_startendtag(self, name: str, attrs: list) -> None:
        self.handle_starttag(name, attrs)
        if name not in VOID and name not in BLOCK and self.path[-1].name == name:
            self._cut(len(self.path) - 1)

    def handle_endtag(self, name: str) -> None:
        self._end({name}, block=name not in BLOCK and name not in DROPPED | ASIDE)

    def handle_data(self, data: str) -> None:
        self.path[-1].items.append(data)


def _without(root: Node, unwanted: Callable[[Node], bool]) -> None:
    stack = [root]
    while stack:
        node = stack.pop()
        node.items = [x for x in node.items if isinstance(x, str) or not unwanted(x)]
        stack.extend(x for x in node.items if not isinstance(x, str))


def _prune(root: Node, by_name: bool = True) -> None:
    """Cut what is beside the article, from the top down.

    What is named as comments goes, unless the page's title is inside. Another element that its name speaks against stays if
    it holds over five sixths of the page's prose and either the title or an article, or if there is no text outside it
    (hardly any, for a form): then it is a layout's wrapper or a form around the page. A mere hint cuts only what is mostly links.
    """
    _without(root, lambda x: x.kind == "never")
    found, paragraph, link, plain = [], {}, {}, {}
    for node, text in root.walk():
        if text is None:
            found.append(node)
            paragraph[id(node)] = node if node.name in BLOCK or node is root else paragraph[id(node.parent)]
            link[id(node)] = node.name == "a" or node is not root and link[id(node.parent)]
            plain[id(node)] = 0
            node.chars = node.linked = 0
        elif length := len(" ".join(text.split())):
            node.chars += length
            if link[id(node)]:
                node.linked += length
            else:
                plain[id(paragraph[id(node)])] += length
    for node in reversed(found):  # children before parents
        node.prose += plain[id(node)] if plain[id(node)] >= LEAST_CHARS else 0
        if node is root:
            continue
        node.parent.chars += node.chars
        node.parent.linked += node.linked
        node.parent.titled |= node.titled
        if node.kind != "comments" or node.titled:
            node.parent.prose += node.prose
    whole, letters = root.prose, root.chars - root.linked

    def unwanted(x: Node) -> bool:
        if x.kind == "comments" and not x.titled:
            return True
        if x.kind == "maybe":
            return 2 * x.linked > x.chars
        if not x.kind or not by_name:
            return False
        outside = letters - (x.chars - x.linked)
        alone = outside < (LEAST_CHARS if x.name in ("form", "fieldset") else 1)
        return not (x.titled and 6 * x.prose > 5 * whole or alone and x.prose)

    _without(root, unwanted)
    for node in found:
        node.chars = node.linked = 0


def blocks(nodes: list[Node]) -> list[str]:
    """Texts between the edges of block elements, in page order, white space inside turned into one space."""
    out, held = [], []

    def close() -> None:
        if text := " ".join("".join(held).split()):
            out.append(text)
        held.clear()

    for top in nodes:
        stack: list[tuple[Node, Iterator]] = []
        node: Node | None = top
        while node is not None or stack:
            if node is not None:
                if node.name in BLOCK:
                    close()
                elif node.name in ("br", "img"):
                    held.append(" ")
                stack.append((node, iter(node.items)))
                node = None
            owner, left = stack[-1]
            for x in left:
                if isinstance(x, str):
                    held.append(x)
                else:
                    node = x
                    break
            else:
                if owner.name in BLOCK:
                    close()
                stack.pop()
        close()
    return out


def _measure(root: Node) -> list[Node]:
    """Fill in every element's letters, letters in links and own text; returns the elements in page order."""
    found: list[Node] = []
    paragraph: dict[int, Node] = {}
    for node, text in root.walk():
        if text is None:
            found.append(node)
            paragraph[id(node)] = node if node.name in BLOCK or node is root else paragraph[id(node.parent)]
        elif text.strip():
            node.chars += len(" ".join(text.split()))
            paragraph[id(node)].own.append(text)
    for node in reversed(found):  # children before parents
        node.own = " ".join(" ".join(node.own).split())
        if node.name == "a":
            node.linked = node.chars
        if node is not root:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
    return found


def _density(node: Node) -> float:
    return node.linked / max(1, node.chars)


def article_nodes(root: Node) -> list[Node]:
    """The best container and the siblings that are kept with it."""
    found, scored = _measure(root), []
    for node in found:
        if node.name not in PARAGRAPHS or len(node.own) < LEAST_CHARS:
            continue
        points = 1 + node.own.count(",") + min(len(node.own) / 100, 3)
        share, up = 1.0, node
        if node.name not in ("div", "section", "article", "main", "body", "html"):
            up = node.parent
        for depth in range(4):
            if up is None:
                break
            if up.points == 0:
                scored.append(up)
                up.points += 5 if up.likely() or up.name in ("article", "main") else 1e-9
            up.points += points * share
            share, up = 0.5 if depth == 0 else share * 2 / 3, up.parent
    best = max(scored, key=lambda x: x.points * (1 - _density(x)), default=None)
    if best is None:
        named = [x for x in found if x.name in ("article", "main") and x.chars]
        return [max(named, key=lambda x: x.chars)] if named else [root]
    whole = [x for x in (best, *best.above()) if x.name == "article"] or [x for x in best.above() if x.name == "main"]
    if whole:
        best = whole[-1]
    if best.parent is None:
        return [best]
    least = max(10.0, 0.2 * best.points * (1 - _density(best)))
    kept = []
    for x in best.parent.items:
        if isinstance(x, str):
            continue
        prose = x.name == "p" and len(x.own) >= PROSE_CHARS and _density(x) < 0.25
        beside = x.name in HEADINGS and not kept or x.points * (1 - _density(x)) >= least or prose
        if x is best or beside:
            kept.append(x)
    return kept


def main_text(html: str) -> str:
    """The page's article, its blocks joined by an empty line; empty if there is no text."""
    for by_name in (True, False):  # if names cut all there was, they are not to be trusted
        tree = Tree()
        tree.feed(html)
        tree.close()
        _prune(tree.root, by_name)
        if text := "\n\n".join(blocks(article_nodes(tree.root))):
            return text
    return ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row.

    Null html is empty and has empty text; a null id or url stays null; repeated rows each give a row. Other columns
    are not read. Whole pages are parsed, whatever their length or nesting.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(x or "") for x in batch.column("html").to_pylist()]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
