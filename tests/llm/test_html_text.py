"""Main text of pages: the given pages by a plain rule, hand-made ones, labelled ones held out."""

import html
import re

import pytest
from pyspark.sql import functions as F

from trackloom.llm import html_text, queries

PAGES = "page_id long, html string"


def texts(spark, pages, **more):
    df = spark.createDataFrame(list(enumerate(pages)), PAGES)
    return [r.text for r in html_text.main_text(df, **more).orderBy("page_id").collect()]


def article_by_rule(page):
    """The given pages hold one article of a heading and paragraphs, which may be cut off."""
    inside = page.split("<article>")[1].split("</article>")[0]
    inside = re.sub(r"<[^>]*$", "", inside)
    parts = (" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside))
    return "\n".join(x for x in parts if x)


def test_given_pages(spark, sf):
    got = {r.page_id: (r.text, r.n_chars) for r in queries.op11_html_text(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    want = {r.page_id: article_by_rule(r.html or "") for r in pages}
    assert got == {k: (v, len(v)) for k, v in want.items()} and any(want.values())


def test_hand_made_pages(spark):
    body = " ".join(["Words of a story that is long enough."] * 8)
    pages = [
        f"<body><header><h2>Site</h2></header><nav><a href='/a'>Home</a></nav><main><h1>A  title\n</h1><p>{body}</p><p>Short.</p><aside>See also</aside><p>x &lt;b&gt; &#233; y</p></main><footer>Imprint</footer>",
        f"<div class='cookie-banner'>We use cookies. {body}</div><article><h1>T</h1><p>{body}</p></article><div id='comments'><article><p>{body}</p></article></div>",
        f"<div class='sidebar'><p>{body}</p></div><div class='content'><p>One<br>two</p><ul><li>first<li>second</ul></div><form><label>Name</label><p>{body}</p></form>",
        f"<script>var a = '<p>{body}</p>';</script><style>p {{ }}</style><!-- <p>{body}</p> --><article><p title='a > b'>{body}</p><script>x</script><p>a < b</p></article><div class=ad>Buy this now</div>",
    ]
    assert texts(spark, pages) == [
        f"A title\n{body}\nShort.\nx <b> é y",
        f"T\n{body}",
        "One two\nfirst\nsecond",
        f"{body}\na < b",
    ]


def test_pages_without_marks_go_by_words_and_links(spark):
    long = " ".join(["word"] * 40)
    page = f"<div><a>One</a> <a>two</a></div><div><a>Three four</a></div><h1>Heading of it</h1><p>{long}</p><p>{long} <a>link</a></p><p>{long}</p><div><a>Next</a></div><div><a>Back to all</a></div>"
    assert texts(spark, [page]) == [f"Heading of it\n{long}\n{long} link\n{long}"]


def test_defined_cases(spark):
    long = "<article><p>" + "a b &amp; c " * 200_000 + "</p></article>"
    cut = "<article><p>Whole paragraph of words.</p><p>cut off <b cla"
    got = texts(spark, [None, "", long, cut, "<article><!-- never closed <p>a</p>", "   \n", "plain words only", "<article><p>a</p></article>", "<article><p>a</p></article>"])
    assert got[:2] == ["", ""] and got[2] == "a b & c " * 199_999 + "a b & c" and got[3] == "Whole paragraph of words.\ncut off"
    assert got[4:6] == ["", ""] and got[7] == got[8] == "a"
    clash = spark.createDataFrame([(1, "<article><p>x y</p></article>", "old", "b")], "page_id long, html string, text string, blocks string")
    row = html_text.main_text(clash).head()
    assert (row.text, row.n_chars, row.blocks) == ("x y", 3, "b")
    assert html_text.main_text(spark.createDataFrame([], PAGES)).count() == 0


def test_held_out_labels(spark):
    """Each labelled page by a tree that has not seen it."""
    pieces = html_text.labelled_pieces(spark)
    right = total = 0
    for page in (0, 2, 5, 9, 14):
        tree = html_text.block_tree(spark, pieces.where(F.col("page") != page))
        held = html_text.labelled_blocks([tuple(r) for r in pieces.where(F.col("page") == page).orderBy("piece").select("page", "main", "html").collect()])
        rows = spark.createDataFrame([(main, dict(zip(html_text.FEATURES, v, strict=True))) for main, v in held], "main int, b struct<" + ",".join(f"{f}:double" for f in html_text.FEATURES) + ">")
        found = rows.select((html_text.is_main(tree, F.col("b")).cast("int") == F.col("main")).alias("ok")).collect()
        right, total = right + sum(r.ok for r in found), total + len(found)
    assert right / total >= 0.8, (right, total)


def test_too_many_labels(spark, monkeypatch):
    monkeypatch.setattr(html_text, "MOST_PIECES", 5)
    with pytest.raises(ValueError, match="at most 5"):
        html_text.block_tree(spark)
