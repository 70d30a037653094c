"""Main text of web pages: flat text blocks, classified by a decision tree over word counts and link density.

A page is cut into flat blocks where a block-level tag begins or ends. A block knows its words, the share of them
inside links, the same of the blocks before and after it, and what the elements around it say of themselves (an
article, a menu, an advert), and whether any block of the page is in an article. A decision tree, trained on a small table of labelled pieces of pages, tells blocks of the
main text from the rest. Pages are cut inside tasks; the tree is a Column over the blocks, so nothing is shuffled.

Defined cases: a null or empty page has no blocks and an empty text; a page of any length is read whole; a tag that the
page's end cuts off is markup; a comment, script or style that is never closed takes the rest of the page. Rows that
repeat are judged alike, an empty table stays empty. Further columns stay as they are; columns named ``text`` and
``n_chars`` give way to the operator's own.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most pieces that a labelled table may have; it is read on the driver when the tree is trained.
MOST_PIECES = 20_000
DEPTH = 6

_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html"
    " legend li main menu nav noscript ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't text of the page.
_RAW = frozenset("iframe math object script style svg template textarea title".split())
#: Elements that close an open one of the same line when they begin.
_CLOSES = {t: frozenset(s.split()) for t, s in {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}.items()}
_LINES = frozenset("p h1 h2 h3 h4 h5 h6".split())
_ASIDE = frozenset("nav header footer aside form menu button select label noscript dialog fieldset".split())
#: Words in class, id and role that name what an element is for.
_ASIDE_WORDS = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer footer header login masthead menu nav navbar navigation"
    " newsletter notice pagination popup promo related search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar widget".split()
)
_MAIN_WORDS = frozenset("article body content entry main post story text".split())

_TOKEN = re.compile(
    r"""<!--(?:.*?--!?>|.*\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"']*+)|["'])*+)(>|\Z)""",
    re.S,
)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_WORDS = re.compile(r"[a-z]+")


class Block(NamedTuple):
    text: str
    words: float
    linked: float
    #: Inside an element that is said to hold the main text, or something beside it.
    inside: float
    beside: float
    heading: float


FEATURES = ("words", "linked", "words_before", "linked_before", "words_after", "linked_after", "inside", "beside", "heading", "marked")
BLOCKS = "array<struct<text string, " + ", ".join(f"{f} double" for f in FEATURES) + ">>"


def _said(tag: str, attributes: str, inside: bool, beside: bool) -> tuple[bool, bool]:
    """What holds inside an element: is it main text, is it beside it."""
    if tag == "main":
        return True, False
    if tag == "article":
        inside = True
    elif tag in _ASIDE and not (tag == "header" and inside):
        beside = True
    if tag not in ("html", "body") and attributes:
        found = {w for m in _NAMES.finditer(attributes) for w in _WORDS.findall((m[1] or m[2] or m[3] or "").lower())}
        main, aside = not found.isdisjoint(_MAIN_WORDS), not found.isdisjoint(_ASIDE_WORDS)
        if aside and not main and not (inside and "header" in found):
            beside = True
        elif main and not aside:
            inside = True
    return inside, beside


def blocks(page: str | None) -> Iterator[Block]:
    """Flat text blocks of a page in order; references are decoded, white space inside a block is one space."""
    if not page:
        return
    stack: list[tuple[str, bool, bool]] = []
    text: list[str] = []
    linked, link_depth, heading, at, end = 0, -1, 0.0, 0, len(page)

    def add(a: int, b: int) -> None:
        nonlocal linked
        if a < b:
            piece = html.unescape(page[a:b])
            text.append(piece)
            if link_depth >= 0:
                linked += len(piece.split())

    def closed() -> Iterator[Block]:
        nonlocal linked
        words = "".join(text).split()
        if words:
            _, inside, beside = stack[-1] if stack else ("", False, False)
            yield Block(" ".join(words), float(len(words)), min(1.0, linked / len(words)), float(inside), float(beside), heading)
        text.clear()
        linked = 0

    while (m := _TOKEN.search(page, at)) is not None:
        add(at, m.start())
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[4] != ">":  # the page ends inside a tag
            break
        if m[1]:
            if tag in _BLOCK:
                yield from closed()
                heading = 0.0
            if tag == "a":
                link_depth = -1
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag not in _BLOCK:
                        yield from closed() if stack[i][1:] != (stack[i - 1][1:] if i else (False, False)) else ()
                    del stack[i:]
                    break
            if link_depth > len(stack):
                link_depth = -1
            continue
        if tag in _RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if not m[3].rstrip().endswith("/") or tag not in ("svg", "math"):
                at = stop.end() if stop else end
            continue
        if tag == "br":
            text.append(" ")
        if tag in _BLOCK:
            yield from closed()
            while stack and (stack[-1][0] in _LINES or stack[-1][0] in _CLOSES.get(tag, ())):
                stack.pop()
            heading = float(tag[0] == "h" and tag[1:].isdigit())
        if tag in _VOID or (m[3].endswith("/") and tag not in _BLOCK):
            continue
        if tag == "a":
            link_depth = len(stack)
        _, inside, beside = stack[-1] if stack else ("", False, False)
        said = _said(tag, m[3], inside, beside)
        if tag in _BLOCK:
            stack.append((tag, *said))
        elif said != (inside, beside):  # a span, label or button that says what it is, is a block of its own
            yield from closed()
            stack.append((tag, *said))
    else:
        add(at, end)
    yield from closed()


def rows_of(found: list[Block]) -> list[dict[str, Any]]:
    """Blocks with the features of their neighbours; outside the page there are no words and no links."""
    edge = Block("", 0.0, 0.0, 0.0, 0.0, 0.0)
    marked = float(any(b.inside and not b.beside for b in found))
    out = []
    for before, b, after in zip([edge, *found], found, [*found[1:], edge], strict=False):
        values = (b.words, b.linked, before.words, before.linked, after.words, after.linked, b.inside, b.beside, b.heading, marked)
        out.append({"text": b.text, **dict(zip(FEATURES, values, strict=True))})
    return out


_ARROW = pa.list_(pa.struct([("text", pa.string()), *((f, pa.float64()) for f in FEATURES)]))


def _cut(pages: pa.Array) -> pa.Array:
    return pa.array([rows_of(list(blocks(p.as_py()))) for p in pages], _ARROW)


def with_blocks(column: Column) -> Column:
    """The array of blocks of a page, with their features."""
    return F.arrow_udf(_cut, BLOCKS)(column)


#: Labelled pieces of pages in order: main text or not, and the piece. ``{n}`` stands for n words, which are counted and never read.
LABELLED: list[list[tuple[int, str]]] = [
    [
        (0, '<html><head><title>{5}</title></head><body><header><div class="logo">{2}</div><nav><ul><li><a href="/">{1}</a></li><li><a href="/">{2}</a></li></ul></nav></header>'),
        (1, "<main><article><h1>{7}</h1><p>{45}</p><p>{3}</p><h2>{3}</h2><p>{80} <a>{3}</a> {20}</p>"),
        (0, "<aside><h3>{2}</h3><ul><li><a>{5}</a></li><li><a>{6}</a></li></ul></aside>"),
        (1, "<p>{30}</p><p>{2}</p></article></main>"),
        (0, "<footer><p>{12}</p><a>{2}</a></footer></body></html>"),
    ],
    [
        (0, '<body><div class="menu"><a>{1}</a> <a>{1}</a> <a>{2}</a></div><div id="cookie-notice"><p>{25}</p><button>{1}</button></div>'),
        (1, '<div class="content"><h1>{4}</h1><p>{60}</p><ul><li>{6}</li><li>{9}</li></ul><blockquote>{18}</blockquote><p>{1}</p></div>'),
        (0, '<div class="comments"><h3>{2}</h3><div class="comment"><b>{2}</b><p>{22}</p></div><div class="comment"><p>{9}</p></div></div>'),
        (0, '<div class="footer">{9} <a>{1}</a></div>'),
    ],
    [
        (0, "<body><nav><ul><li><a>{1}</a></li><li><a>{1}</a></li><li><a>{1}</a></li></ul></nav>"),
        (0, '<div class="ad">{9}</div>'),
        (1, "<article><h1>{6}</h1><p><b>{6}<br><p>{70}</p><p>{2}</p><p>{14}</p></article>"),
        (0, "<footer>{14}</footer></body>"),
    ],
    [
        (0, '<body><nav><a>{1}</a> | <a>{1}</a></nav><div class="ad">{3}</div>'),
        (1, "<article><h1>{1}</h1><p>{4}</p></article>"),
        (0, '<section id="comments"><article><p>{40}</p></article><article><p>{15}</p></article></section><footer>{30}</footer>'),
    ],
    [
        (0, "<body><table><tr><td><a>{1}</a></td><td><a>{1}</a></td><td><a>{2}</a></td></tr></table>"),
        (1, "<div><p>{55}</p><p>{38}</p><p>{47} <a>{2}</a> {12}</p><p>{66}</p></div>"),
        (0, "<div><a>{4}</a></div><div><a>{5}</a></div><div><a>{3}</a></div><p>{5} <a>{4}</a></p>"),
    ],
    [
        (0, "<body><div><a>{1}</a> <a>{1}</a> <a>{1}</a> <a>{1}</a></div><div>{2}</div><div><a>{3}</a></div>"),
        (1, "<div><h1>{8}</h1><p>{35}</p><p>{90}</p><p>{24}</p><p>{41}</p></div>"),
        (0, "<ul><li><a>{2}</a></li><li><a>{4}</a></li><li><a>{3}</a></li></ul><div>{4} <a>{1}</a> <a>{1}</a></div>"),
    ],
    [
        (0, '<body><header>{6}</header><form><label>{3}</label><input><p>{12}</p></form><div role="banner">{11}</div>'),
        (1, '<div class="post"><div class="entry"><h2>{5}</h2><p>{28}</p><figure><figcaption>{10}</figcaption></figure><p>{51}</p></div>'),
        (0, '<div class="share"><a>{1}</a><a>{1}</a></div><div class="related"><h4>{2}</h4><p>{30}</p></div></div><div class="newsletter"><p>{16}</p></div>'),
    ],
    [
        (0, '<body><div class="notice">{35}</div><div class="sidebar"><p>{60}</p><p>{45}</p></div>'),
        (1, '<main><h1>{3}</h1><p>{5}</p><table><tr><td>{1}</td><td>{2}</td></tr></table><pre>{12}</pre></main>'),
        (0, '<div id="disclaimer"><p>{80}</p></div><footer><ul><li><a>{2}</a></li><li>{3}</li></ul><p>{40}</p></footer>'),
    ],
    [
        (0, "<body><p><a>{2}</a></p><p><a>{3}</a></p>"),
        (1, "<h1>{5}</h1><p>{33}</p><p>{27}</p><p>{19}</p>"),
        (0, "<p><a>{3}</a> <a>{2}</a></p>"),
    ],
    [
        (0, '<body><aside><p>{70}</p></aside><nav><p>{20}</p></nav>'),
        (1, '<article><header><h1>{9}</h1></header><section><h2>{2}</h2><p>{15}</p><p>{120}</p></section><ol><li>{4}</li><li><a>{3}</a></li></ol><p><a>{6}</a></p>'),
        (0, '<div class="ad"><p>{30}</p></div><div class="advert">{4}</div><footer>{3}</footer></article>'),
    ],
    [
        (0, "<body><div>{3}</div><div>{14} <a>{2}</a></div><p>{40}</p>"),
        (1, "<article><h1>{6}</h1><p><a>{2}</a></p><p>{2}</p><ul><li><a>{5}</a></li><li>{1}</li><li><a>{1}</a> {8}</li></ul><p>{1}</p></article>"),
        (0, "<p>{24}</p><div>{2}</div><div>{60}</div><p>{9} <a>{3}</a></p>"),
    ],
    [
        (0, '<body><p>{18}</p><div><a>{1}</a><a>{2}</a></div>'),
        (1, '<div id="main-content"><p><a>{3}</a></p><p>{2}</p><h3><a>{3}</a></h3><p>{150}</p><p><a>{1}</a></p><p>{1}</p></div>'),
        (0, "<div>{7}</div><p>{110}</p>"),
    ],
    [
        (0, "<body><div>{2}</div><div>{1}</div><ul><li><a>{1}</a></li><li><a>{1}</a></li></ul><div>{2}</div>"),
        (1, "<h1>{9}</h1><p>{62}</p><p>{21}</p><h2>{3}</h2><p>{44}</p>"),
        (0, "<div>{3} <a>{2}</a></div><div>{2} <a>{1}</a></div>"),
    ],
    [
        (0, "<body><div><a>{2}</a></div><div><a>{24}</a></div>"),
        (1, "<div><p>{40}</p><p>{6}</p><p>{50}</p><p>{3}</p><p>{70}</p><p>{11}</p><p>{26}</p></div>"),
        (0, "<p><a>{20}</a></p><p><a>{22}</a> {9}</p>"),
    ],
    [
        (0, "<body><div>{4}</div><div><a>{25}</a></div>"),
        (1, "<p>{12}</p><p>{30}</p><p>{10}</p><p>{28}</p><p>{9}</p><p>{35}</p><p>{5}</p><p>{33}</p>"),
        (0, "<div>{5}</div><div>{3}</div>"),
    ],
    [
        (0, "<div>{8}</div><div><a>{2}</a></div><div>{2}</div><div><a>{1}</a> <a>{1}</a></div><div>{11}</div><div><a>{3}</a></div>"),
        (1, "<div><p>{40}</p><p>{2}</p><p>{50}</p><p>{1}</p><p>{33}</p><p>{2}</p><p>{29}</p></div>"),
        (0, "<div><a>{2}</a></div><div>{10}</div><div><a>{1}</a></div><div>{2}</div>"),
    ],
    [
        (0, "<div><a>{3}</a></div><p>{6}</p><div><a>{2}</a></div><p>{7}</p><div><a>{2}</a></div>"),
        (1, "<p>{61}</p><p>{1}</p><p>{44}</p><p>{2}</p><p>{57}</p>"),
        (0, "<div><a>{4}</a></div><p>{12}</p><div><a>{2}</a></div><p>{1}</p>"),
    ],
    [(1, "<article><h1>{6}</h1><p>{50}</p><p>{4}</p></article>")],
    [(1, "<article><p>{64}</p><p>{3}</p></article>"), (0, "<div>{3}</div>")],
    [(1, "<main><p>{22}</p></main>"), (0, "<footer>{5}</footer>")],
    [(0, "<nav>{4}</nav>"), (1, "<article><p>{3}</p></article>")],
    [(0, "<div><a>{2}</a></div>"), (1, "<article><p><a>{3}</a></p><p>{2} <a>{4}</a></p></article>")],
    [(1, "<h1>{5}</h1><p>{60}</p><p>{45}</p><p>{80}</p>")],
    [(1, "<p>{30}</p>")],
    [(1, "<p>{52}</p><p>{36}</p>"), (0, "<p><a>{2}</a></p>")],
    [(0, "<div><a>{2}</a></div>"), (1, "<h2>{4}</h2><p>{75}</p><p>{48}</p>")],
]


def labelled_pieces(spark: SparkSession) -> DataFrame:
    """The labelled table used unless one is given: page, piece (its place), main (0 or 1), html."""
    filled = lambda s: re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * int(m[1])), s)
    rows = [(p, i, main, filled(piece)) for p, pieces in enumerate(LABELLED) for i, (main, piece) in enumerate(pieces)]
    return spark.createDataFrame(rows, "page int, piece int, main int, html string")


def labelled_blocks(pieces: list[tuple[Any, int, str]]) -> list[tuple[int, list[float]]]:
    """(main, features) of all blocks of pages given as (page, main, piece) in order. A piece ends where a block ends."""
    out, marks = [], {}
    for page, main, piece in pieces:
        marks.setdefault(page, []).append((main, piece))
    for parts in marks.values():
        of: list[int] = []
        for i in range(1, len(parts) + 1):
            seen = sum(1 for _ in blocks("".join(x for _, x in parts[:i])))
            of += [parts[i - 1][0]] * (seen - len(of))
        rows = rows_of(list(blocks("".join(x for _, x in parts))))
        out += [(main, [r[f] for f in FEATURES]) for main, r in zip(of, rows, strict=True)]
    return out


def block_tree(spark: SparkSession, labelled: DataFrame | None = None, depth: int = DEPTH) -> Any:
    """Decision tree over ``FEATURES``, trained on at most ``MOST_PIECES`` labelled pieces (an error beyond)."""
    pieces = (labelled or labelled_pieces(spark)).orderBy("page", "piece").select("page", "main", "html").limit(MOST_PIECES + 1).collect()
    if len(pieces) > MOST_PIECES:
        raise ValueError(f"at most {MOST_PIECES} labelled pieces")
    rows = spark.createDataFrame([(float(main), v) for main, v in labelled_blocks([tuple(p) for p in pieces])], "label double, v array<double>")
    learner = DecisionTreeClassifier(maxDepth=depth, maxBins=64, seed=1)
    return learner.fit(rows.coalesce(1).select("label", array_to_vector("v").alias("features")))


def is_main(tree: Any, block: Column) -> Column:
    """The tree's verdict on a block, as a Column."""

    def verdict(node: Any) -> Column:
        if "Leaf" in node.getClass().getSimpleName():
            return F.lit(node.prediction() == 1.0)
        at, most = node.split().featureIndex(), node.split().threshold()
        return F.when(block[FEATURES[at]] <= most, verdict(node.leftChild())).otherwise(verdict(node.rightChild()))

    return verdict(tree._call_java("rootNode"))


def main_text(pages: DataFrame, html_col: str = "html", labelled: DataFrame | None = None) -> DataFrame:
    """``pages`` with ``text`` (blocks of the main text in page order, joined by a line feed) and ``n_chars`` (its code points)."""
    tree = block_tree(pages.sparkSession, labelled)
    kept = F.filter(with_blocks(F.col(html_col).cast("string")), lambda b: is_main(tree, b))
    out = pages.withColumn("text", F.array_join(F.transform(kept, lambda b: b["text"]), "\n"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
