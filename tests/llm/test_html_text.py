import html as entities
import re

import pytest

from tunewright.llm import html_text

P = "The quick brown fox jumps over the lazy dog and runs on through the wood."
PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>'
    '<header><a href="/">Home</a> Site name</header><nav><ul><li><a href="/a">A</a></li></ul></nav>'
    '<div class="ad">Buy now, it is cheap and good for everybody who reads this.</div>'
    "<article>@@</article>"
    '<section id="comments"><p>First! What a nice page this is, I read it all day.</p></section>'
    "<aside>More like this</aside><form><label>Mail</label><input></form><footer>&copy; me</footer></body></html>")


def test_article_blocks_in_order():
    body = f"<h1>Head&amp;line</h1><p><b>{P}<br>again<br><p>Short.</p><ul><li>one<li>two &nbsp; three</ul><pre>a\n  b</pre>"
    assert html_text.main_text(PAGE.replace("@@", body, 1)) == f"Head&line\n{P} again\nShort.\none\ntwo three\na b"


@pytest.mark.parametrize("junk", [
    '<div class="cookie-notice">We use cookies on this page, do you agree?</div>', "<nav>menu</nav>", "<script>if (a<b) x()</script>",
    '<div id="comments"><p>Great article, thank you very much for it.</p></div>', '<aside class="x">side</aside>', "<style>p{}</style>",
    '<form>name <input> <button>send</button></form>', "<!-- hidden <p>words</p> -->", '<div hidden>gone</div>',
    '<div role="navigation">go</div>', '<p class="ads sponsored">buy</p>', "<footer>end</footer>", "<template><p>t</p></template>",
])
def test_boilerplate_inside_the_article_goes(junk):
    assert html_text.main_text(PAGE.replace("@@", f"<p>{P}</p>{junk}<p>Last.</p>", 1)) == f"{P}\nLast."


def test_page_without_article_element():
    body = "".join(f"<p>{P} {i}</p>" for i in range(6))
    page = (f'<body><div class="menu"><a>a</a><a>b</a></div><div id="wrap"><div class="text"><h2>Head</h2>{body}</div>'
            '<div class="sidebar"><p>Some other text stands here</p></div></div><div class="footer">(c)</div></body>')
    got = html_text.main_text(page).split("\n")
    assert got[-6:] == [f"{P} {i}" for i in range(6)] and "Some other text stands here" not in got


def test_truncated_and_odd_pages():
    assert html_text.main_text("") == ""
    assert html_text.main_text("plain words without any tag") == "plain words without any tag"
    assert html_text.main_text("<script>x</script><nav>y</nav>") == ""
    assert html_text.main_text(PAGE.split("@@")[0] + f"<p>{P}<p>cut he").endswith("cut he")
    assert html_text.main_text(f"<article><p>{P}</p></p></div></b><p>x</article>") == f"{P}\nx"
    deep = "<div>" * 3_000 + P + "</div>" * 3_000
    assert html_text.main_text(deep) == P
    long = "<article>" + f"<p>{P}</p>" * 5_000 + "</article>"
    assert html_text.main_text(long) == "\n".join([P] * 5_000)


def test_table_of_columns(documents, spark):
    rows = [(1, "u", f"<article><p>{P}</p></article>", "t"), (1, "u", f"<article><p>{P}</p></article>", "t"), (2, None, None, None),
            (None, "u", "", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html_text.extracted(df)
    got = sorted(((r.page_id, r.text, r.n_chars) for r in out.collect()), key=str)
    assert got == sorted([(1, P, len(P)), (1, P, len(P)), (2, "", 0), (None, "", 0)], key=str)
    assert html_text.extracted(df.limit(0)).collect() == []


def plain(page):
    """The generated pages' article, by regular expressions."""
    inner = re.search(r"<article>(.*?)(</article>|$)", page, re.DOTALL)[1]
    parts = re.split(r"</?(?:h1|p)>", inner)
    texts = [" ".join(entities.unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in parts]
    return "\n".join(t for t in texts if t)


def test_generated_pages(spark, documents):
    import os

    path = "/root/testdata/sf0.001/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("driver tables are absent")
    out = html_text.extracted(spark.read.parquet(path)).collect()
    assert out and all(r.text == plain(r.html) for r in out)


@pytest.mark.parametrize("page", [
    '<body><div id="top"><a>One</a> <a>Two</a></div><div id="wrap"><div class="text">@@</div></div><footer>(c) me</footer></body>',
    "<body><div><a>One</a> <a>Two</a></div>@@<div><a>Three</a></div><footer>(c) me</footer></body>",
])
def test_short_lead_and_closing_lines_of_pages_without_article(page):
    body = ["A short lead.", *[" ".join([P] * (4 + i % 2)) for i in range(6)], "Only a few words left.", "That is all, thanks."]
    text = html_text.main_text(page.replace("@@", "".join(f"<p>{x}</p>" for x in body)))
    assert text.split("\n") == body


def test_trailing_list_of_a_div_page():
    body = "".join(f"<p>{' '.join([P] * 5)}</p>" for _ in range(6))
    page = f'<body><div><div class="text">{body}<ul><li>one</li><li>two</li><li>three</li></ul></div></div><footer>(c)</footer></body>'
    assert html_text.main_text(page).split("\n")[6:] == ["one", "two", "three"]


@pytest.mark.parametrize("junk", [
    "<span hidden>no</span>", '<span class="ad">buy</span>', '<span class="shareCount">12</span>', '<em style="display: none">x</em>',
    '<a class="share-button" href="#">Share</a>', "<button>Go</button>", '<span aria-hidden="true">*</span>',
])
def test_junk_inside_a_line_goes(junk):
    assert html_text.main_text(PAGE.replace("@@", f"<p>{P} text{junk} tail</p><p>Last.</p>", 1)) == f"{P} text tail\nLast."


@pytest.mark.parametrize("name", [
    'class="share-price"', 'id="search-results"', 'class="form-and-function"', 'class="side-effects"', 'id="social-history"',
    'class="review-discussion-of-methods"',
])
def test_a_word_in_a_name_is_no_name(name):
    assert html_text.main_text(PAGE.replace("@@", f"<p>{P}</p><div {name}><p>Stays.</p></div>", 1)) == f"{P}\nStays."


def test_ratios_choose_on_pages_without_article_and_names(monkeypatch):
    menu = "".join(f'<li><a href="/{i}">Topic number {i}</a></li>' for i in range(8))
    body = "".join(f"<p>{' '.join([P] * (3 + i % 2))}</p>" for i in range(6))
    end = "".join(f"<span><a href=/{i}>Other {i}</a></span> " for i in range(4))
    page = f"<body><div><ul>{menu}</ul></div><div><div>{body}</div><div>{end}</div></div><div><i>(c)</i> <b>us</b></div></body>"
    wanted = "\n".join(" ".join([P] * (3 + i % 2)) for i in range(6))
    assert html_text.main_text(page) == wanted
    monkeypatch.setattr(html_text, "smoothed", lambda ratios: ratios * 0 + 1)
    assert html_text.main_text(page) != wanted


def test_links_in_an_article_and_in_prose_stay():
    refs = "<ul><li><a href=/1>First source</a></li><li><a href=/2>Second source</a></li></ul>"
    assert html_text.main_text(PAGE.replace("@@", f"<p>{P}</p>{refs}", 1)).endswith("First source\nSecond source")
    linked = "".join(f"<p>{P} <a href=/x>{P}</a> {P}</p>" for _ in range(4))
    assert html_text.main_text(f"<body><div>{linked}</div></body>").count("\n") == 3
