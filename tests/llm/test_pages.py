import html as H
import re

import numpy as np

from plumbline.llm.pages import extracted, main_text, smoothed, threshold

PAGE = """<!DOCTYPE html><html><body class="has-sidebar"><header><h1>Site</h1></header>
<div id="cookie-notice">We use cookies on this site to improve it, accept them all now please thanks.</div>
<nav><ul><li><a href="/">Home</a><li><a href="/b">About us</a></ul></nav>
<div class="wrap"><div class="content"><h1>A &amp; B&nbsp;title</h1><p>Long   paragraph one two three
four five six seven eight nine ten.<ul><li>first point<li>second</ul><p>Short.<form><input><label>Name</label>
<textarea>type</textarea></form><p>Another <i>long</i> paragraph with <b>many</b> words to be found<br>in here.
<div class="AdBanner">Buy our wonderful products today, they are cheap and cheerful and all yours.</div>
<table><tr><td>cell 1<td>cell 2</table><script>var x = "</p><p>no</p>";</script><style>p{}</style>
<section id="comments"><h3>Comments</h3><p>Nice post, I really liked that a lot, thank you very much!</p></section>
</div><aside>side text of some length that could pass for a paragraph of the article</aside></div>
<footer>&copy; someone</footer>"""


def test_one_page():
    assert main_text(PAGE).split("\n") == [
        "A & B title", "Long paragraph one two three four five six seven eight nine ten.", "first point",
        "second", "Short.", "Another long paragraph with many words to be found in here.", "cell 1", "cell 2",
    ]


def test_given_pages(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    got = {r["page_id"]: r for r in extracted(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S).group(1).replace("<br>", " ")
        parts = [re.sub(r"\s+", " ", H.unescape(re.sub(r"<[^>]+>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(x for x in parts if x)
        assert got[r["page_id"]]["text"] == want
        assert got[r["page_id"]]["n_chars"] == len(want)


def test_messy_rows(spark):
    long = "<article>" + "<p>some words of a paragraph here</p>" * 20_000
    rows = [(1, "u", None), (2, None, ""), (None, "u", "plain words"), (4, "u", "<nav>menu</nav>"), (5, "u", long),
            (6, "u", "<p>a<p>b</div></span>"), (6, "u", "<p>a<p>b</div></span>"), (7, "u", "<p>&#128512;&lt;x&gt;"),
            (8, "u", "<div><<<>>"), (9, "u", "<script>never closed")]
    df = spark.createDataFrame([(*r, "t", 3) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = [tuple(r) for r in extracted(df).collect()]
    assert len(got) == len(rows)
    found = {i: (t, n) for i, _, t, n in got}
    assert found[1] == found[2] == found[4] == found[9] == ("", 0)
    assert found[None] == ("plain words", 11) and found[6] == ("a\nb", 3) and found[7] == ("😀<x>", 4)
    assert found[5][0].count("\n") == 19_999
    assert extracted(df.limit(0)).collect() == []


def test_title_in_the_header_of_an_article():
    page = "<header><h1>Site</h1></header><article><header><h1>Title</h1><p>by me</p></header><p>Some text of the article.</article>"
    assert main_text(page) == "Title\nSome text of the article."


TEXT = "Words of a paragraph that is long enough to be read as a part of the article itself. "


def test_no_part_of_an_article_is_dropped():
    part = lambda n: f"<p>{TEXT * n}</p>"
    menu = "<div><ul>" + "".join(f"<li><a href='/{i}'>Link {i}</a>" for i in range(9)) + "</ul></div>"
    for tag in ("article", "main", "div"):
        page = f"{menu}<{tag}><h1>Title</h1><p>lead</p><div class=body>{part(3) * 3}</div></{tag}>{menu}"
        assert main_text(page).split("\n") == ["Title", "lead"] + [(TEXT * 3).strip()] * 3
        page = f"<{tag}><section>{part(13)}</section><section>{part(7)}</section></{tag}>{menu}"
        assert [len(x) for x in main_text(page).split("\n")] == [len(TEXT) * 13 - 1, len(TEXT) * 7 - 1]
    page = f"<body>{menu}<div><div><h1>Title</h1></div><div>{part(9)}</div></div></body>"
    assert main_text(page).split("\n")[0] == "Title"


def test_names_of_states_and_of_the_whole_page():
    body = f"<h1>Title</h1><p>{TEXT * 3}</p>"
    want = f"Title\n{(TEXT * 3).strip()}"
    side = f"<div class='sidebar-left'><p>{TEXT}</p></div><div id=comments><p>{TEXT * 9}</p></div>"
    for name in ("content has-sidebar", "post comments-open", "content-sidebar-wrap", "no-comments", "widget"):
        for tag in ("div", "article", "section"):
            if name == "widget" and tag == "article":
                continue
            assert main_text(f"<{tag} class='{name}'>{body}</{tag}>{side}") == want, name
    for name in ("sidebar", "site-footer", "comments", "AdBanner", "cookie-notice"):
        assert main_text(f"<div>{body}<p>{TEXT}</p></div><div class='{name}'><p>{TEXT}</p></div>").count("\n") == 2, name


def test_smoothing_and_threshold():
    assert np.allclose(smoothed(np.ones(9)), 1)
    assert 2 < threshold(np.array([0.0, 1.0, 0.5, 9.0, 10.0])) < 9
    assert threshold(np.array([3.0])) == 3.0
