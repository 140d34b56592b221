"""Main text of layouts that the fit has not seen, hard markup, and the time that hard markup takes."""

import time

import pytest

from fillwise.llm import op5_html as page

S = "The river rose again on Tuesday, and people in the lower town moved their furniture upstairs before dark."
T = "Nobody could say how long the flood would last, but the council opened two schools for those who had to leave. Buses ran until midnight."
U = "It was the third time this decade."
HEAD = "<html><head><title>River rises{}</title></head><body>"
HELD_OUT = {
    "blog": (
        HEAD.format(" - My blog") + '<div class="site-branding">Site name</div><div class="nav-menu"><a href="/">Home</a> <a href="/a">About</a></div>'
        f'<div class="hentry"><h1>River rises</h1><p>{S}</p><p>{T}</p><p>{U}</p></div><div class="footer">Copyright 2020</div></body></html>',
        ["River rises", S, T, U],
    ),
    "inner advert and footer": (
        HEAD.format("") + f'<article><h1>River rises</h1><p>{S}</p><aside class="advert">Buy now</aside><p>{T}</p><p>{U}</p><footer>Share this</footer></article>',
        ["River rises", S, T, U],
    ),
    "bare": (HEAD.format("") + f"<h1>River rises</h1><p>{S}</p><p>{T}</p><p>{U}</p></body></html>", ["River rises", S, T, U]),
    "news": (
        HEAD.format(" | Herald") + '<header><div id="logo">Herald</div><nav><a href="/">News</a><a href="/s">Sport</a></nav></header><main>'
        f'<article class="story"><header><h1>River rises</h1></header><p>{S}</p><figure><img src="x.jpg"><figcaption>The bridge at noon on the day '
        f'of the flood.</figcaption></figure><p>{T}</p><div class="sponsored-content"><p>Our partner sells pumps that work in any weather, order '
        f'today.</p></div><p>{U}</p><p>{S} {T}</p></article><section id="comments"><h3>Comments</h3><div class="comment"><p>I was there, it was worse '
        'than they say, and nobody came to help us.</p></div></section></main><aside class="related"><h3>More</h3><ul><li><a href="/1">Rain to go on'
        "</a></li></ul></aside><footer>All rights reserved. Contact us by mail.</footer></body></html>",
        ["River rises", S, "The bridge at noon on the day of the flood.", T, U, f"{S} {T}"],
    ),
    "notice, share bar and form": (
        HEAD.format("") + '<div id="cookie-consent"><p>We use cookies to make this site better. You may accept or leave them.</p><button>OK</button></div>'
        f'<div id="content"><h1>River rises</h1><div class="article-text"><p>{S}</p><p>{T}</p></div><div class="share-buttons">Tell a friend</div></div>'
        '<div id="sidebar"><h4>Popular</h4><ul><li><a href="/1">Rain to go on</a></li><li><a href="/2">Snow</a></li></ul></div>'
        '<form class="newsletter"><p>Get our letter every week.</p><input></form></body></html>',
        ["River rises", S, T],
    ),
    "bare divisions": (
        HEAD.format("") + '<div>Herald</div><div><a href="/">News</a> <a href="/s">Sport</a></div>'
        f"<div><h1>River rises</h1><p>{S}</p><p>{T}</p><p>{U}</p><p>{S} {T}</p></div><div>Herald Press 2020</div></body></html>",
        ["River rises", S, T, U, f"{S} {T}"],
    ),
}


@pytest.fixture(scope="module")
def model(spark):
    return page.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


@pytest.mark.parametrize("name", HELD_OUT)
def test_layouts_that_the_fit_has_not_seen(spark, model, name):
    html, want = HELD_OUT[name]
    got = page.main_text(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"), model).first()
    assert got["text"] == "\n".join(want)


def test_articles_of_the_pages_table_come_out_whole(spark, model):
    """Each page names its article; adverts stand outside of it."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in page.main_text(pages, model).join(pages.select("page_id", "html"), "page_id").collect():
        inner = r["html"][r["html"].index("<article>") : r["html"].index("</article>")] if "<article>" in (r["html"] or "") else ""
        assert r["text"] == "\n".join(t for _, t, _ in page.Page(inner).blocks)


def texts(html):
    return [t for _, t, _ in page.Page(html).blocks]


def test_marks_of_invented_pages_mean_nothing_elsewhere():
    html = '<div data-part="1">a</div><p data-main="1">b</p>'
    assert page.Page(html).marks == {} and page.Page(html, marked=True).marks == {1: 1}


def test_very_long_attributes():
    long = "a>" * 100_000
    assert texts(f"<p data-x=\"{long}\">x<p title='{long}'>y") == ["x", "y"]


def test_html_elements_end_open_svg():
    assert texts("<p>a</p><svg><path d=1><div>b</div><p>c</p>") == ["a", "b", "c"]
    assert texts("<svg><foreignObject><p>in it</p></foreignObject></svg><p>c</p>") == ["c"]
    assert texts("<math><mi>x</mi><p>c</p>") == ["c"]
    assert texts("<svg><g></p>after") == ["after"]


@pytest.mark.parametrize("piece", ['<a "', "<a '\"", '<a "<a "x"', "<a b=\"c' ", "<svg><svg/>", "<a <a \"", "<p title=\"", "<!--", "<title>"])
def test_time_grows_with_the_length(piece):
    took = []
    for n in (20_000, 80_000):
        began = time.process_time()
        page.Page(piece * n)
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 0.5
