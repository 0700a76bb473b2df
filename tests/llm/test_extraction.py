"""Page extraction: hand-written pages of many layouts, and the test table against a cut by its own markup."""

import html as entities
import re

import numpy as np
import pytest

from daymark.llm import extraction as ex

TREE = ex.trained()


def text_of(page):
    found = ex.blocks(page)
    return "\n".join(b[0] for b, x in zip(found, ex.features(found)) if ex.is_main(TREE, x))


PAGES = [
    ("<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Site</a></header><nav><ul><li><a href=/a>A</a></ul></nav>"
     "<div class='cookie-notice'>We use cookies on this site, as all the others do, to make it better for you and for us.</div>"
     "<article><h1>Title</h1><p>First &amp; best\n  paragraph.</p><p>x</p><aside>Related: some long text that is not part of it at all, of course.</aside>"
     "<p>Last <a href=x>linked</a> one</p></article><section id=comments><h2>Comments</h2><p>A reader wrote a long comment about this article here.</p></section>"
     "<form><label>Name</label><input><button>Send</button></form><footer>&copy; 2024</footer></body></html>", "Title\nFirst & best paragraph.\nx\nLast linked one"),
    ("<main><h2>One<p>two<p>three<br>four<ul><li>five<li>six</ul></main><div class=sidebar><p>A long text in a side bar that nobody should take for the article.</div>", "One\ntwo\nthree\nfour\nfive\nsix"),
    ("<article><p>a &lt;b&gt; c</p><script>var t='</p><p>no</p>'</script><!-- <p>no</p> --><noscript>no</noscript><p>1 < 2 &#233;&nbsp;d</p></article>", "a <b> c\n1 < 2 é d"),
    ("<div class='post-content'><p>Short.</p></div><div class='ad'>Buy now, it is cheap and it is good and everybody has it already.</div>", "Short."),
    ("<article><p>cut in the mid", "cut in the mid"), ("<article><p>cut in a tag</p><p cla", "cut in a tag"),
    ("<article><header><h1>Head</h1></header><p>Body<div class='comments'><p>No</p></div><footer>f</footer></article>", "Head\nBody"),
    ("<body><p>" + "long text of a page without any names " * 5 + "</p><p><a href=x>link</a> <a>link</a></p></body>", "long text of a page without any names " * 4 + "long text of a page without any names"),
    ("<div class='layout has-sidebar'><main><h2>The Site</h2><div class='siteFooter'>f</div><article class='post no-comments'><p>a</p></article><p>b</p></main></div>", "a"),
    ("<div id=cookieBanner>c</div><ol class='breadcrumbs-list'><li>x</ol><div itemprop='articleBody'>text</div>", "text"),
    ("<p hidden>no</p><article><p title='a > b'>yes</p></article>", "yes"), ("", ""), ("   ", ""), ("<", "") , ("<article></article>", ""),
]


@pytest.mark.parametrize("page,want", PAGES)
def test_pages(page, want):
    assert text_of(page) == want


def test_the_tree_knows_its_labelled_table():
    rows = np.array(ex.LABELLED, float)
    assert all(ex.is_main(TREE, r[:-1]) == bool(r[-1]) for r in rows)


def test_left_out_blocks_are_predicted():
    rows = np.array(ex.LABELLED, float)
    right = 0
    for fold in range(8):
        held = np.arange(len(rows)) % 8 == fold
        tree = ex.trained(rows[~held])
        right += sum(ex.is_main(tree, r[:-1]) == bool(r[-1]) for r in rows[held])
    assert right / len(rows) > 0.9


def plain(page):
    body = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    lines = re.sub(r"<[^>]*>", "", re.sub(r"<(p|h1|/p|/h1|br)>", "\n", body)).split("\n")
    return "\n".join(t for t in (" ".join(entities.unescape(x).split()) for x in lines) if t)


def test_pages_of_the_test_table(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    from daymark.llm.queries import QUERIES

    for r in QUERIES["op10_main_text"](spark, "/root/testdata/sf0.01").collect():
        assert r["text"] == plain(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


def test_odd_rows(spark):
    long = "<article>" + "<p>word</p>" * 60_000 + "</article>"
    pages = spark.createDataFrame([(1, "u", None, 3), (2, None, "", 3), (None, "u", "<article>a</article>", 3), (4, "u", long, 3), (4, "u", long, 3)], "page_id long, url string, html string, text int")
    rows = ex.main_text(pages).collect()
    assert sorted((str(r["page_id"]), len(r["text"])) for r in rows) == [("1", 0), ("2", 0), ("4", 5 * 60_000 - 1), ("4", 5 * 60_000 - 1), ("None", 1)]
    assert ex.main_text(pages.limit(0)).count() == 0
    assert ex.split_blocks(pages.where("page_id = 1 or page_id is null")).count() == 1
