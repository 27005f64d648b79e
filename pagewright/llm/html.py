"""Main-text extraction from HTML by tree scoring.

Paragraph-like blocks give points for length and commas to their ancestors, halved
for each level; an element's points are discounted by its link density. The best
container is kept, with those siblings that carry similar points or read like
paragraphs. Every page is handled alone, so the operator is one Arrow pass without a shuffle.

What an element's class and id names say is weighed, never final: text below a compound name such as
``ad-slot`` gives a quarter of the points, text below a plain ``comments`` none, and both are left out of the result.
But an element that holds the only main part of a page, or the best container, is kept whatever its name, and
a page that would be left empty is read again without regard to names.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from pagewright.llm.common import text_batches

# Element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe noembed noframes xmp title svg math".split())
BOILERPLATE = frozenset("nav aside footer dialog menu button select option object canvas audio video head".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr img".split()
)
PARAGRAPHS = frozenset("p pre td blockquote dd".split())
MAIN = frozenset("article main".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav "
    "ol p pre section table ul".split()
)
# Words in class and id names that mark what is not the article.
UNWANTED_WORDS = frozenset(
    "ad ads adsbygoogle advert advertisement adverts advertising alert banner breadcrumb breadcrumbs comment comments cookie cookies "
    "consent disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification pager "
    "pagination popup promo promoted recommended related replies reply respond share sharing sidebar skip social sponsor sponsored "
    "subscribe toolbar widget widgets".split()
)
HEADER_WORDS = frozenset("header masthead".split())  # inside the article they hold its title
STATE_WORDS = frozenset("has no with without is not hide show enabled disabled fixed sticky open closed free active toggle on off".split())  # no-sidebar, comments-open
TITLE_WORDS = frozenset("entry post article story content section chapter title main".split())  # entry-header holds the title
CONTENT_WORDS = frozenset("article content main story entry post body text prose".split())
UNWANTED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>""", re.S)
_CUT_TAG = re.compile(r"<[a-zA-Z/!][^<>]*\Z")
_ATTRIBUTE = re.compile(r"""([^\s"'/=>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")  # every one, so that no value is read as a name
_TELLING = frozenset("class id role hidden aria-hidden style".split())
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WANTED, _DOUBTFUL, _BY_NAME, _NEVER = range(4)
_DOUBT = 0.25  # of its points a block below a doubtful element gives


class _Node:
    __slots__ = ("tag", "parent", "children", "main", "unwanted", "weight", "points", "text_len", "link_len")

    def __init__(self, tag: str, parent: _Node | None, unwanted: int = _WANTED, main: bool = False):
        self.tag, self.parent, self.unwanted, self.main = tag, parent, unwanted, main
        self.children: list[_Node | str] = []
        self.points, self.weight = 0.0, 1.0
        self.text_len = self.link_len = 0


@lru_cache(maxsize=1 << 14)
def _told_by(names: str) -> tuple[int, bool]:
    """What class or id names say of an element, and whether that is only due to header words."""
    level, headers, content = _WANTED, True, False
    for name in names.split():
        parts = [x.lower() for x in _PART.findall(name)]
        bad = UNWANTED_WORDS.intersection(parts)
        if len(parts) > 1 and parts[0] not in ("widget", "widgets"):
            bad -= {"widget", "widgets"}
        if not bad:
            content |= not CONTENT_WORDS.isdisjoint(parts)
            continue
        if len(parts) > 1 and (not STATE_WORDS.isdisjoint(parts) or bad <= HEADER_WORDS and not TITLE_WORDS.isdisjoint(parts)):
            continue
        level = max(level, _BY_NAME if len(parts) == 1 else _DOUBTFUL)
        headers &= bad <= HEADER_WORDS
    if level == _DOUBTFUL and content:
        level = _WANTED
    return level, level != _WANTED and headers


def _unwanted(tag: str, attributes: str, parent: _Node | None = None) -> int:
    """0 for what may be the article, 1 and 2 for what a compound or a plain name marks, 3 for what never is."""
    if tag in BOILERPLATE:
        return _NEVER
    level = _BY_NAME if tag == "form" else _WANTED
    if tag in ("body", "html") or not attributes.strip():
        return level
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name not in _TELLING:
            continue
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return _NEVER
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return _NEVER
        elif name == "role":
            if value.lower() in UNWANTED_ROLES:
                return _NEVER
        elif tag != "main":
            told, by_header = _told_by(value)
            if told and not (by_header and _inside_main(parent)):
                level = max(level, told)
    return level


def _is_main(tag: str, attributes: str) -> bool:
    return tag in MAIN or "role" in attributes and any(n.lower() == "role" and v.strip("\"'").lower() in MAIN for n, v in _ATTRIBUTE.findall(attributes))


def _inside_main(node: _Node | None) -> bool:
    while node is not None and not node.main:
        node = node.parent
    return node is not None


def parse(page: str) -> _Node:
    """A forgiving tree of block elements and links; other inline elements only pass their text on.

    Unclosed and stray tags are tolerated: an end tag closes up to the nearest open element
    of its name, a new block ends an open paragraph.
    """
    page = _CUT_TAG.sub("", page)
    root = node = _Node("#root", None)
    at, end = 0, len(page)
    while at < end:
        found = _TOKEN.search(page, at)
        if not found:
            node.children.append(html_lib.unescape(page[at:]))
            break
        if found.start() > at:
            node.children.append(html_lib.unescape(page[at : found.start()]))  # here, as a reference never spans a tag
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            if tag in INLINE and tag != "a":
                continue
            scan = node
            while scan is not root and scan.tag != tag:
                if tag == "a" and scan.tag not in INLINE:
                    scan = root
                    break
                scan = scan.parent
            if scan is not root:
                node = scan.parent
            continue
        if tag in RAW:
            if not found[3].endswith("/"):
                close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = close.end() if close else end if tag in ("script", "style") else at
            continue
        if tag == "br":
            node.children.append(" ")
            continue
        if tag in VOID or tag in INLINE and tag != "a":
            continue
        if tag in CLOSES_P or tag in ("li", "dt", "dd", "tr", "td", "th", "body"):
            while node is not root and node.tag == "a":
                node = node.parent
            if node.tag == "p" and tag in CLOSES_P:
                node = node.parent
            if tag in ("li", "dt", "dd", "tr", "td", "th"):
                same = {"dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "tr": ("td", "th", "tr", "p")}.get(tag, (tag, "p"))
                while node is not root and node.tag in same:
                    node = node.parent
        elif tag == "a" and node.tag == "a":
            node = node.parent
        unwanted = _NEVER if tag == "header" and not _inside_main(node) else _unwanted(tag, found[3], node)
        child = _Node(tag, node, unwanted, _is_main(tag, found[3]))
        node.children.append(child)
        node = child
    return root


def _clean(text: str) -> str:
    return " ".join(text.split())


def _below(root: _Node, most: int) -> list[_Node]:
    """The elements that are reached through elements unwanted at most so much, in page order.

    Iterative: pages may nest deeper than Python's stack.
    """
    order: list[_Node] = []
    stack = [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, _Node) and c.unwanted <= most)
    return order


def _above(node: _Node | None) -> Iterator[_Node]:
    """The element and all that hold it."""
    while node is not None:
        yield node
        node = node.parent


def _trust_main_parts(root: _Node) -> None:
    """Names count for nothing on elements that hold the page's main part, if all of its kind lie below such names."""
    nodes = _below(root, _BY_NAME)
    kinds = ([n for n in nodes if n.tag != "article" and n.main], [n for n in nodes if n.tag == "article"], [n for n in nodes if n.tag == "h1"])
    parts = next(filter(None, kinds), [])
    if not any(all(not x.unwanted for x in _above(n)) for n in parts):
        for n in parts:
            for x in _above(n):
                x.unwanted = _WANTED


def _score(root: _Node) -> list[_Node]:
    """Points for every container; returns all that may hold the article in page order."""
    order = _below(root, _DOUBTFUL)
    for node in order:
        node.points, node.text_len, node.link_len = 0.0, 0, 0
        node.weight = (node.parent.weight if node.parent else 1.0) * (_DOUBT if node.unwanted else 1.0)
    for node in reversed(order):  # children first
        own = "".join(c for c in node.children if isinstance(c, str))
        linked = [c for c in node.children if isinstance(c, _Node) and c.tag == "a" and c.unwanted <= _DOUBTFUL]
        own_len = length = len(_clean(own)) if own else 0
        node.text_len += own_len
        if node.tag == "a":
            node.link_len = node.text_len
        block = own
        if linked:
            block += "".join(s for a in linked for s in a.children if isinstance(s, str))
            length = len(_clean(block))
        if node.tag != "a" and length >= 25 and (node.tag in PARAGRAPHS or node.tag in ("div", "section", "article", "main", "li", "body", "#root")):
            points = node.weight * (1 + block.count(",") + min(length / 100, 3))
            share, up = 1.0, node.parent if node.tag in PARAGRAPHS else node
            while up is not None and share > 0.01:
                up.points += points * share
                share, up = share / 2, up.parent
        if node.parent is not None:
            node.parent.text_len += node.text_len
            node.parent.link_len += node.link_len
    return order


def _density(node: _Node) -> float:
    return node.link_len / node.text_len if node.text_len else 0.0


def _blocks(node: _Node, out: list[str]) -> None:
    """Texts of the blocks below a node, in page order, without unwanted elements."""
    run: list[str] = []
    stack: list[tuple[_Node, int]] = [(node, 0)]

    def end_block() -> None:
        if run and (text := _clean("".join(run))):
            out.append(text)
        run.clear()

    while stack:
        top, k = stack.pop()
        if k == 0 and top.tag != "a":
            end_block()
        while k < len(top.children):
            child = top.children[k]
            k += 1
            if isinstance(child, str):
                run.append(child)
            elif not child.unwanted:
                stack.append((top, k))
                stack.append((child, 0))
                break
        else:
            if top.tag != "a":
                end_block()


def main_text(page: str | None) -> str:
    """The article's text: blocks in page order, joined by one space; empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    _trust_main_parts(root)
    text = _best_text(root)
    if not text:
        doubtful = [n for n in _below(root, _BY_NAME) if n.unwanted and n.tag != "form"]
        for node in doubtful:
            node.unwanted = _WANTED
        text = _best_text(root) if doubtful else ""
    return text


def _best_text(root: _Node) -> str:
    """Text of the best container and of the siblings that join it."""
    order = _score(root)
    for node in order:
        node.points *= 1 - _density(node)
    best = max(order, key=lambda n: n.points)  # the first of equals, as order is page order
    if best.points <= 0:
        marked = [n for n in order if n.main]
        bodies = [n for n in order if n.tag == "body"]
        best = marked[0] if marked else bodies[0] if bodies else root
    for node in _above(best):
        node.unwanted = _WANTED
    best = next((n for n in _above(best) if n.main), best)
    kept = [best]
    if best.parent is not None:
        least = 0.2 * best.points if best.main else max(10.0, 0.2 * best.points)
        joins = (lambda s: s.main and s.points >= least) if best.main else (lambda s: s.tag != "a" and _joins(s, least))
        kept = [s for s in best.parent.children if isinstance(s, _Node) and not s.unwanted and (s is best or joins(s))]
    out: list[str] = []
    for node in kept:
        _blocks(node, out)
    return " ".join(out)


def _joins(node: _Node, least: float) -> bool:
    if node.points >= least:
        return True
    density = _density(node)
    if re.fullmatch(r"h[1-6]", node.tag):
        return density < 0.3
    return node.tag in PARAGRAPHS and (node.text_len > 80 and density < 0.25 or 0 < node.text_len <= 80 and density == 0)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) for every row.

    Edge cases: a null or empty page, and one with no text outside boilerplate, gives the
    empty text and 0; null ids and URLs pass through; repeated rows are handled one by one; other
    columns are ignored; an empty table gives no row. Whole pages are read, whatever their length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    rows = pages.select("page_id", "url", "html")
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
