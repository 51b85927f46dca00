import re

import pytest

from wardlens.llm.html_blocks import digest, main_text


def test_article_without_its_surroundings():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p><article>";</script></head>
    <body><header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
    <!-- <article>no</article> --><article><header><h1>Head &amp; line</h1><span>by me</span></header><p><b>First</b> para&shy;graph
    with  <a href='x>y'>link</a>.<br>same&nbsp;block<p>Second &lt;p&gt; &#233;<div class="ad box">Buy!</div><p>x</p>
    <ul><li>one<li>two</ul><table><tr><td>a<td>b</tr></table><form>name <input></form><aside>side</aside>
    <section id="comments"><p>A long reader comment</p></section></article><div class="sidebar"><p>side</p></div>
    <footer>&copy; me</footer></body></html>"""
    assert main_text(page) == "Head & line\nFirst para­graph with link. same block\nSecond <p> é\nx\none\ntwo\na b"


def test_page_without_article_element():
    body = "".join(f"<p>{'word ' * 30}{i}</p>" for i in range(3))
    page = f"<body><div id='menu'><a>a</a></div><div><a href=1>Home</a> <a>News</a></div><div class=content><h1>Title</h1>{body}<p>end</p></div>" \
           "<div class='comments'><p>" + "reader " * 30 + "</p></div><div role=contentinfo>foot</div></body>"
    lines = main_text(page).split("\n")
    assert lines[-4:] == [*(("word " * 30 + str(i)) for i in range(3)), "end"] and "reader" not in lines[-1]


def test_odd_input():
    assert main_text(None) == main_text("") == main_text("<nav>x</nav>") == ""
    assert main_text("plain text only") == "plain text only"
    assert main_text("<article>a</article>") == "a"
    assert main_text("<article><p>unclosed") == "unclosed"
    assert main_text("<article>" + "<p>x" * 20_000).count("\n") == 19_999
    assert main_text("1 < 2 <article>3 < 4 & 5</article><script>") == "3 < 4 & 5"


LONG = ["Some words of the story that go on for a while, so that they are a paragraph of it number %d." % k for k in range(6)]
STORY = "<h1>Title</h1>" + "".join(f"<p>{t}</p>" for t in LONG)
WANTED = "\n".join(["Title", *LONG])
MENU = "<ul class='menu'><li><a href=1>Home</a><li><a href=2>News of the day</a></ul>"
FOOT = "<footer>All rights reserved by the people who wrote it</footer>"


@pytest.mark.parametrize("page", [
    f"<div class='content-sidebar-wrap'>{MENU}<main><article>{STORY}</article></main></div>{FOOT}",
    f"<body class='has-sidebar'><div class='has-sidebar'><article>{STORY}</article></div>{MENU}{FOOT}",
    f"<div id='page-with-nav'>{MENU}<article>{STORY}</article></div>{FOOT}",
    f"<form class='form-page'>{MENU}<article>{STORY}</article></form>{FOOT}",
    f"{MENU}<article><div class='entry-content share-enabled'>{STORY}</div></article>{FOOT}",
    f"{MENU}<article><div class='article-header'><h1>Title</h1></div>{STORY.removeprefix('<h1>Title</h1>')}</article>{FOOT}",
    f"{MENU}<article><header><h1>Title</h1><p>by me</p><p>{LONG[0]}</p></header>{''.join(f'<p>{t}</p>' for t in LONG[1:])}</article>{FOOT}",
    f"{MENU}<main><article>{STORY}</article><p><a href=3>Read now</a></p><p><a href=4>Next story</a></p></main>{FOOT}",
    f"{MENU}<div class='page-form'><div class='text'>{STORY}</div></div>{FOOT}",
    f"{MENU}<div>{STORY}</div>{FOOT}",
])
def test_wrappers_do_not_lose_the_article(page):
    assert main_text(page) == WANTED


def test_several_and_nested_articles():
    second = "<article><h2>Other</h2><p>It is short.</p></article>"
    assert main_text(f"{MENU}<article>{STORY}</article>{second}{FOOT}") == WANTED + "\nOther\nIt is short."
    nested = f"<article><p>Before.</p>{second}<p>After it.</p></article>"
    assert main_text(f"{MENU}{nested}{FOOT}") == "Before.\nOther\nIt is short.\nAfter it."
    comments = "<section class='comments'><article class='comment'><p>A reader wrote this long remark about the story, again and again.</p></article></section>"
    assert main_text(f"<article>{STORY}</article>{comments}") == main_text(f"<article>{STORY}{comments}</article>") == WANTED


def test_a_dropped_block_is_a_gap():
    page = f"{MENU}<div>{STORY}<div class='advert'>Buy it all</div><p>So it ends.</p></div>{FOOT}"
    assert main_text(page) == WANTED + "\nSo it ends."


def test_ties_and_deep_pages():
    same = "<article><p>Equal text.</p></article>"
    assert main_text(same * 3) == "\n".join(["Equal text."] * 3)
    deep = "<div>" * 20_000 + "<article><p>deep</p></article>" + "</div>" * 20_000
    assert main_text(deep) == "deep"
    assert main_text("<div class='nav'>" * 5_000 + "<p>all of it</p>") == "all of it"


def test_rows(spark):
    frame = spark.createDataFrame([(1, None, None, "t"), (2, "u", "<article>é</article>", "t"), (2, "u", "", "t")], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, digest(frame).collect()), key=str) == [(1, None, "", 0), (2, "u", "", 0), (2, "u", "é", 1)]
    assert digest(frame.limit(0)).count() == 0


def test_query_against_the_article_element(spark, sf_dir):
    """In these tables each page has one article whose blocks are a heading and paragraphs."""
    import html

    from wardlens.llm.queries import QUERIES

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = QUERIES["op3_html_text"](spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.DOTALL)[1]
        blocks = re.split(r"</?(?:p|h1)>", article)
        plain = [" ".join(html.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in blocks]
        assert r.text == "\n".join(p for p in plain if p)
        assert r.n_chars == len(r.text)
