from unitloom.llm import html_text

PAGE = """<!DOCTYPE html><html><head><title>Site</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site name</h1><form><input><label>Find</label></form></header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav>
<div class="cookie-notice">We use cookies</div><aside>Popular posts</aside><div class=ad>Buy now &amp; save</div>
<article class="post with-sidebar"><h1>Title &eacute;</h1><p>First   <b>bold</b>ly <i>said</i>.<br>Second&nbsp;line<p>Short.
<div class="ad">Inner advert</div><ul><li>One<li>Two</ul><blockquote>Said &lt;so&gt;</blockquote><p>A long paragraph of plain words that goes on for quite a while, as an article does.</p>
<section id="comments"><article class="comment"><p>Nice post, thanks a lot for all these many words!</p></article></section></article>
<footer>&copy; 2024</footer></body></html>"""


def test_only_the_article_is_left():
    want = ["Title é", "First boldly said. Second line", "Short.", "One", "Two", "Said <so>", "A long paragraph of plain words that goes on for quite a while, as an article does."]
    assert html_text.main_text(PAGE).split("\n") == want


def test_pages_without_article_element():
    body = "<p>" + "</p><p>".join(f"Sentence number {i} of a body text with enough words to be dense." for i in range(6)) + "</p>"
    page = f"<html><body><div class=menu><a>x</a><a>y</a></div><div id=main-text>{body}</div><div class=footer>end</div></body></html>"
    assert html_text.main_text(page).count("\n") == 5 and "end" not in html_text.main_text(page)


def test_awkward_pages():
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text(" \n ") == ""
    assert html_text.main_text("<script>only()</script>") == ""
    assert html_text.main_text("just text &amp; more") == "just text & more"
    assert html_text.main_text("<article>" + "<div>" * 5000 + "deep") == "deep"
    assert html_text.main_text("</p></b><article><p>open") == "open"
    long = "<article>" + "<p>word &lt; word</p>" * 20_000 + "</article>"
    assert html_text.main_text(long) == "\n".join(["word < word"] * 20_000)


def test_extract_keeps_every_row(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (None, None, None, None), (2, "v", "", "x")], "page_id long, url string, html string, text string")
    out = html_text.extract(pages).select("row.page_id", "row.text", html_text.F.col("text").alias("found")).collect()
    assert len(out) == 4 and sorted(r["found"] == "" for r in out) == [False, False, True, True]
    assert html_text.extract(spark.createDataFrame([], "page_id long, html string")).collect() == []
