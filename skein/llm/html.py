"""Main-text extraction by composite text density.

A tolerant parser builds the page's element tree.  Scripts, styles, forms and the like, elements that are parts of a page by
their tag (``nav``, ``footer``, ``aside`` ...), and those that a class, id or role names beyond doubt (adverts, cookies, reader comments) are
left out; they stand in the tree too, so they end where any element ends.  One that holds most of the page's text
outside links is a wrapper: it is opened, and what is left out within it is judged likewise.

For every other element with C characters, T tags, LC characters and LT tags of links, its density is the
characters per tag, weighed down by its share of links (page-wide links set the base of the logarithm).  An element's
density sum adds up its children's densities; the page as a whole (its body, or a wrapper of all its
text) adds those of its own paragraphs only.  The element with the
largest sum holds the article, whatever its name; the lowest density on the path from it to below the body is the threshold.  Of what lies
beside the path, elements stay that reach the threshold, hold paragraphs and are as long as a block of the article, and
headings and short blocks before or between what stays; in an element of the path itself its own paragraphs, lists and bare text
stay too, unless they are mostly links.

Words that may say what an element is for, or what its text is about (``related``, ``search``, ``discussion`` ...), lower the sum of
what they name, and keep it from being taken beside the path; inside the article they leave out a container only where its
density is below the threshold as well, or most of it is links.  They never leave out a heading, paragraph or list item.

Defined cases: null or empty html and pages without text give an empty text; repeated
rows are rows of their own; unclosed, misnested and very deep tags are read as far as they go.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import carry, restored, table

#: Elements without end tag; elements that end a line of text; elements that are not article text.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
_PARTS = frozenset("aside dialog footer form header menu nav search".split())  # of a page; may be wrappers
_NEVER = frozenset("applet audio button canvas datalist embed frame frameset head iframe input map noscript object option script select style svg template textarea title video".split())
#: Words of a class, id or role that tell beyond doubt what an element is for, and those that may be its subject as well.
_SURE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr newsletter navbar menubar breadcrumb breadcrumbs pagination pager masthead sidebar "
    "comment comments commentlist disqus respond modal overlay popup toolbar skip complementary contentinfo".split()
)
_MAYBE = frozenset(
    "promo promotion banner nav navigation menu aside widget footer reply replies discussion notice notices notification alert subscribe subscription signup login share sharing social related recommended recommendations search".split()
)
_COMMENTS = frozenset("comment comments commentlist disqus respond".split())
#: What words of the second kind may leave out, and elements whose text is their parent's own.
_HOLDERS = frozenset("article aside center details dir div dl fieldset figure main ol section table ul".split())
_CONTAINERS = frozenset("article aside center details dialog div fieldset footer form header main menu nav search section".split())
#: How a word of the second kind weighs what it names.
_DOUBT = 0.25
_ROLE_WORDS = re.compile(r"[a-z]+")
#: Names that tell what a wrapper has, or the state it is in, not what it is for.
_MODIFIED = re.compile(r"(?<![a-z])(?:has|with|without|no)[-_]+[a-z]+|(?<![a-z])[a-z]+[-_]+(?:open|closed|enabled|disabled|free|ready)(?![a-z])")
#: Why an element is left out: for good, as a page part or by its role, as comments.
_GONE, _PART, _SAID = 1, 2, 3
#: A wrapper without article element that has fewer characters outside links is not opened.
_LEAST = 80
#: A start tag ends these open elements, up to the elements that bound the search.
_ENDS = {tag: ("p",) for tag in _BLOCKS - {"body", "html"}} | {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "a": ("a",), "button": ("button",)}
_BOUNDS = frozenset("applet article aside blockquote body button dialog div dl footer form head header html main nav object ol search section select svg table template ul".split())
_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: Start tags that end an open svg, and elements that no end tag of an outer element ends.
_NOT_SVG = frozenset("b big blockquote center code dd div dl dt em h1 h2 h3 h4 h5 h6 hr i img li menu ol p pre small span strong sub sup table u ul".split())
_SHUT = frozenset("applet object template".split())
_ARTICLES = ("article", "main")
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup")


def _words(value: str) -> list[str]:
    return _ROLE_WORDS.findall(_MODIFIED.sub(" ", value.lower()))


class _Element:
    __slots__ = ("tag", "parent", "parts", "named", "chars", "tags", "link_chars", "link_tags", "density", "total", "out", "doubt")

    def __init__(self, tag: str, parent: _Element | None, named: bool = False, out: int = 0):
        self.tag, self.parent, self.named, self.out, self.doubt = tag, parent, named, out, False
        self.parts: list = []  # strings and elements
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


class _Tree(HTMLParser):
    """The page's elements; those that are left out say so."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Element("html", None)
        self.open: Counter = Counter()  # open elements that any end tag may end
        self.reach: Counter = Counter()  # open elements that a block's end tag may end
        self.scopes: list[tuple[_Element, Counter, Counter]] = []  # blocks left out, and the counters around them

    def _push(self, element: _Element) -> None:
        self.at.parts.append(element)
        self.at = element
        self.open[element.tag] += 1
        self.reach[element.tag] += 1
        if element.out and (element.tag in _BLOCKS or element.tag in _NEVER or element.tag in ("td", "th", "caption")):
            self.scopes.append((element, self.open, self.reach))
            self.open = Counter()
            if element.tag in _SHUT:
                self.reach = Counter()

    def _close(self, tag: str) -> None:
        while self.at.parent is not None:
            done, self.at = self.at, self.at.parent
            if self.scopes and self.scopes[-1][0] is done:
                _, self.open, self.reach = self.scopes.pop()
            self.open[done.tag] -= 1
            self.reach[done.tag] -= 1
            if done.tag == tag:
                return

    def _open(self, tag: str) -> bool:
        """Whether an end tag ends an open element: an inline one none outside the block left out that it is in."""
        if self.open[tag] > 0:
            return True
        if not self.scopes:
            return False
        return self.scopes[-1][0].tag == tag or (tag in _BLOCKS or tag in ("td", "th", "caption")) and self.reach[tag] > 0

    def handle_starttag(self, tag: str, attrs) -> None:
        if self.at.tag == "head" and tag not in _HEAD:
            self._close("head")
        if tag in _NOT_SVG and self.reach["svg"] and not self.reach["foreignobject"]:
            self._close("svg")
        for other in _ENDS.get(tag, ()):
            if self.reach[other]:
                node = self.at
                while node.parent is not None and node.tag != other and node.tag not in _BOUNDS:
                    node = node.parent
                if node.tag == other:
                    self._close(other)
        if tag in ("html", "body"):
            return
        if tag in _VOID:
            if tag in ("br", "hr", "wbr"):
                self.at.parts.append(_Element(tag, self.at))
            return
        out = self._left_out(tag, attrs)
        if tag != "frame":
            element = _Element(tag, self.at, tag in _ARTICLES or any(k == "role" and v == "main" for k, v in attrs), out)
            element.doubt = not out and tag in _HOLDERS and any(value and key in ("class", "id", "role") and not _MAYBE.isdisjoint(_words(value)) for key, value in attrs)
            self._push(element)

    def _left_out(self, tag: str, attrs) -> int:
        if tag in _NEVER:
            return _GONE
        out = _PART if tag in _PARTS and (tag != "header" or not (self.reach["article"] or self.reach["main"])) else 0
        for key, value in attrs:
            if key in ("hidden",) or key == "aria-hidden" and value == "true":
                return _GONE
            if value and key in ("class", "id", "role") and tag not in _ARTICLES:
                found = _SURE.intersection(_words(value))
                if found:
                    out = max(out, _PART if found.isdisjoint(_COMMENTS) else _SAID)
        return out

    def handle_startendtag(self, tag: str, attrs) -> None:
        drawn = self.reach["svg"]
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and (tag == "svg" or drawn and self.reach["svg"]):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self._open(tag):
            self._close(tag)

    def handle_data(self, data: str) -> None:
        if self.at.tag == "head" and not data.isspace():
            self._close("head")
        self.at.parts.append(data)


def _open_wrappers(root: _Element) -> None:
    """Keep the elements left out that are wrappers: they hold most of the page's text outside links."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [p for p in node.parts if isinstance(p, _Element) and p.out != _GONE]
    if not any(n.out for n in order):
        return
    plain: Counter = Counter()  # characters outside links; those of comments count for the comments alone
    articles = set()
    for node in reversed(order):
        if node.tag == "a":
            plain[id(node)] = 0
        else:
            plain[id(node)] += sum(len(p.strip()) for p in node.parts if isinstance(p, str))
        if (node.tag in _ARTICLES or id(node) in articles) and node.out != _SAID:
            articles.update((id(node), id(node.parent)))
        if node.parent is not None and node.out != _SAID:
            plain[id(node.parent)] += plain[id(node)]
    page, at, named = plain[id(root)], root, False
    while True:
        left, todo = [], [at]
        while todo:
            node = todo.pop()
            if node.out:
                left.append(node)
                continue
            named |= node.named
            todo += [p for p in node.parts if isinstance(p, _Element) and p.out != _GONE]
        # where the page names an article outside, what is left out must hold nearly all text
        found = [n for n in left if n.out == _PART and plain[id(n)] > page * (0.9 if named else 0.5) and (plain[id(n)] >= _LEAST or id(n) in articles)]
        if not found and at is root and page == sum(plain[id(n)] for n in left if n.out == _PART):
            # all of the page's text but some parts is within what is named after comments
            found = [n for n in left if n.out == _SAID and plain[id(n)] >= _LEAST]
        if not found:
            return
        at = max(found, key=lambda n: plain[id(n)])
        if at.out == _SAID:
            page = plain[id(at)]
        at.out = 0


def _measure(root: _Element) -> list[_Element]:
    """Fill in the counts, densities and density sums; returns the elements, parents first."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [p for p in reversed(node.parts) if isinstance(p, _Element) and not p.out]
    for node in reversed(order):
        node.chars += sum(len(p.strip()) for p in node.parts if isinstance(p, str))
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
        if up := node.parent:
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
    share = root.link_chars / max(root.chars, 1)
    for node in order:
        node.density = _density(node.chars, max(node.tags, 1), node.link_chars, node.link_tags, share)
        if node.parent:
            node.parent.total += node.density
    return order


def _density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    if not chars:
        return 0.0
    plain = chars / tags
    if not share:
        return plain
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + share * chars + math.e)
    weight = math.log(chars / max(link_chars, 1) * tags / max(link_tags, 1)) / max(math.log(base), 0.05)
    return plain * max(weight, 0.0)


def _text(roots: list[_Element]) -> str:
    """The blocks' texts in page order."""
    blocks: list[str] = []
    line: list[str] = []

    def end() -> None:
        if found := " ".join("".join(line).split()):
            blocks.append(found)
        line.clear()

    for root in roots:
        todo: list = [root]
        while todo:
            part = todo.pop()
            if part is None:
                end()
            elif isinstance(part, str):
                line.append(part)
            elif part.out:
                line.append(" ")
            else:
                if part.tag in ("br", "td", "th"):
                    line.append(" ")
                if part.tag in _BLOCKS:
                    end()
                    todo.append(None)
                todo += reversed(part.parts)
        end()
    return "\n\n".join(blocks)


def _parsed(html: str) -> _Tree:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree


def main_text(html: str | None) -> str:
    """The article's text, its blocks joined by an empty line."""
    if not html:
        return ""
    tree = _parsed(html)
    _open_wrappers(tree.root)
    order = _measure(tree.root)
    if not tree.root.chars:
        return ""
    page = _page(tree.root)
    best = _densest(order, page)
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    whole = set(map(id, page))
    threshold = min((n.density for n in path if id(n) not in whole), default=best.density)
    _leave_doubtful(best, threshold)
    blocks = _text([best]).split("\n\n")
    least = sum(map(len, blocks)) / len(blocks)
    for i in range(len(path)):
        if i or id(best) in whole:
            path[i].parts = _kept(path[i], path[i - 1] if i else None, threshold, least, i > 0 and id(path[i]) in whole)
    return _text([tree.root])


def _page(root: _Element) -> list[_Element]:
    """The page as a whole: the root, and wrappers that hold all of its text, a menu or a line of bare text among it."""
    chain = [root]
    while True:
        inside = [p for p in chain[-1].parts if (p.strip() if isinstance(p, str) else p.chars and not p.out)]
        if len(inside) != 1 or isinstance(inside[0], str) or inside[0].tag not in _CONTAINERS:
            break
        chain.append(inside[0])
    while len(chain) > 1 and not any(p.tag in _CONTAINERS and (p.link_chars * 2 > p.chars or not _paragraphs(p)) for p in chain[-1].parts if isinstance(p, _Element) and not p.out and p.chars):
        chain.pop()
    return chain


def _densest(order: list[_Element], page: list[_Element]) -> _Element:
    """The element with the largest density sum; what a doubtful word names weighs less, and the page has its own paragraphs' only."""
    best, doubt = page[-1], {}
    own = [p for p in best.parts if isinstance(p, str) or not p.out and p.tag not in _CONTAINERS]
    most = sum(len(p.strip()) / 4 if isinstance(p, str) else p.density for p in own)
    whole = set(map(id, page))
    for node in order[1:]:
        doubt[id(node)] = node.doubt or doubt.get(id(node.parent), False)
        weight = (node.total or node.density / 4) * (_DOUBT if doubt[id(node)] else 1)
        if weight > most and id(node) not in whole:
            best, most = node, weight
    while best.tag not in _BLOCKS and best.parent is not None:
        best = best.parent  # an inline element's block
    return best


def _leave_doubtful(article: _Element, threshold: float) -> None:
    """Leave out what a word may name within the article where it is thinner than the article, or mostly links."""
    todo = [article]
    while todo:
        node = todo.pop()
        for p in node.parts:
            if isinstance(p, _Element) and not p.out:
                if p.doubt and (p.density < threshold or p.link_chars * 2 > p.chars):
                    p.out = _PART
                else:
                    todo.append(p)


def _kept(above: _Element, on_path: _Element | None, threshold: float, least: float, page: bool) -> list:
    """What stays of an element of the path: the path, what is dense and long enough beside it, what leads up to or lies
    between these; and, unless it is the page as a whole, its own paragraphs and text."""
    runs: list[tuple[list, bool, bool]] = []  # (parts, stays by itself, may stay between others)
    inline: list = []

    def end() -> None:
        if inline:
            chars = sum(len(p.strip()) if isinstance(p, str) else p.chars for p in inline)
            links = sum(p.link_chars for p in inline if not isinstance(p, str))
            tags = max(1, sum(p.tags + 1 for p in inline if not isinstance(p, str)))
            plain = links * 2 <= chars
            runs.append((list(inline), plain and chars > 0 and (not page or chars / tags >= threshold), plain))
            inline.clear()

    for p in above.parts:
        if isinstance(p, str) or p.tag not in _BLOCKS and p is not on_path:
            if isinstance(p, str) or not p.out:
                inline.append(p)
            continue
        end()
        if p is on_path:
            runs.append(([p], True, True))
        elif not p.out:
            links, dense = p.link_chars * 2 > p.chars, p.density >= threshold
            if p.tag in _CONTAINERS:  # a line of bare text is no part of an article of paragraphs
                stays = dense and not links and p.chars >= least and _paragraphs(p)
            else:
                stays = dense if page else not links or dense
            runs.append(([p], stays and not p.doubt and p.chars > 0, not links and not p.doubt))
    end()
    first = next((i for i, r in enumerate(runs) if r[1]), 0)
    last = max((i for i, r in enumerate(runs) if r[1]), default=-1)
    out: list = []
    for i, (parts, stays, may) in enumerate(runs):
        heads = i < first and isinstance(parts[0], _Element) and parts[0].tag in _HEADINGS and may
        if stays or heads or first < i < last and may and (not page or not _holds(parts[0])):
            out += parts
        else:
            out.append(" ")
    return out


def _paragraphs(element: _Element) -> bool:
    """Whether an element has blocks of text of its own or in its containers."""
    todo = [element]
    while todo:
        for p in todo.pop().parts:
            if isinstance(p, _Element) and not p.out and p.chars:
                if p.tag in _CONTAINERS:
                    todo.append(p)
                elif p.tag in _BLOCKS:
                    return True
    return False


def _holds(part) -> bool:
    return isinstance(part, _Element) and part.tag in _CONTAINERS


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without the html, with text and n_chars (its code points); columns of these names are replaced, all others carried along."""
    replaced = (html_col, "text", "n_chars")
    rows = pages.select(carry(pages, *replaced), F.col(html_col).cast("string").alias("h"))
    made = StructType([rows.schema["c"], StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [main_text(h) for h in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=made.names)

    return rows.mapInArrow(run, made).select(*restored(pages, *replaced), "text", "n_chars")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
