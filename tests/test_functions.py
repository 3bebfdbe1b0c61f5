"""Scalar functions against pinned pairs."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import split as S
from lodestone.functions import text as X
from lodestone.functions import urls as U
from lodestone.functions.html import readable_text


def values(spark, rows, expression, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


URLS = {
    "example.com": "https://example.com/",
    "http://example.com/path#frag": "http://example.com/path/",
    "https://example.com/path?q=1": "https://example.com/path?q=1",
    "https://example.com//path//": "https://example.com/path/",
    "ftp://example.com": "",
    "http://example.com/file.html": "http://example.com/file.html",
    "http://example.com/path?b=2&a=1": "http://example.com/path?a=1&b=2",
    None: "",
}


def test_normalize_url(spark):
    assert values(spark, list(URLS), U.normalize_url) == list(URLS.values())


VALID = {
    "http://example.com/page": True,
    "http://sub.example.org/another/page.html": True,
    "http://docs.sub.example.org/api/reference": True,
    "http://example.com/api/docs": True,
    "http://example.com/api/data": True,
    "http://otherdomain.com/page": False,
    "http://example.com/image.jpg": False,
    "http://example.com/login": False,
    "mailto:someone@example.com": False,
    "http://example.com/a#b": False,
    None: False,
}


def test_valid_content_url(spark):
    assert values(spark, list(VALID), lambda c: U.is_valid_content_url(c, ["example.com", "sub.example.org"])) == list(VALID.values())


def test_absolute_link(spark):
    base = F.lit("http://h.org/a/b?x=1#f")
    links = ["/c", "c", "//k.org/d", "?y=2", "#z", "https://m.org/", ""]
    found = ["http://h.org/c", "http://h.org/a/c", "http://k.org/d", "http://h.org/a/b?y=2", "http://h.org/a/b?x=1#z", "https://m.org/", "http://h.org/a/b?x=1"]
    assert values(spark, links, lambda c: U.absolute_link(base, c)) == found


def test_dot_segments(spark):
    from urllib.parse import urljoin

    base = "http://h.org/a/b/c.html"
    links = ["../x", "./y", "/a/../z", "../../../up", "..", ".", "d/./e/../f/", "../x?q=../y#../z", "/a/.b/..c", "g..", "//k.org/a/../b", "https://m.org/a/../b"]
    assert values(spark, links, lambda c: U.absolute_link(F.lit(base), c)) == [urljoin(base, x) for x in links]


def test_page_links(spark):
    from lodestone.functions.html import page_links

    page = """<A HREF='one.html?a=1&amp;b=2'>One &amp; only</A><a class=x href=two>Tw<b>o</b></a><a name="n">no</a><a href="three">open
      <a data-href="no" href = "fo&#117;r" href="no">Four</a><!-- <a href="gone">gone</a> --><script>"<a href='js'>"</script><a href="">self</a><a href=' last '>Last"""
    bases = [f"<base href='/docs/'><base href='/no/'>{page}", page, None, "", "<a", "plain"]
    got = values(spark, bases, page_links)
    links = [("one.html?a=1&b=2", "One & only"), ("two", "Two"), ("three", "open"), ("four", "Four"), ("", "self"), ("last", "Last")]
    assert [[tuple(x) for x in row] for row in got] == [[(*x, "/docs/") for x in links], [(*x, None) for x in links], [], [], [], []]
    assert values(spark, ["/docs/", None], lambda c: U.absolute_link(U.page_base(F.lit("http://h.org/a/b"), c), F.lit("x"))) == ["http://h.org/docs/x", "http://h.org/a/x"]


def test_file_slug(spark):
    assert values(spark, ["https://www.example.com/a b?c=d", "", "%2F%2F", "x" * 50, "100%"], U.file_slug) == ["example.com_a_b_c_d", "default", "default", "x" * 40, "100%"]


def test_link_priority(spark):
    assert values(spark, ["http://a.org/guide/api-guide", "http://a.org/x"], lambda c: F.round(U.link_priority(c, F.lit("API")), 6)) == [
        pytest.approx(1 / 4.01, abs=1e-6),
        pytest.approx(1 / 1.01, abs=1e-6),
    ]


def test_page_key_and_file(spark):
    key = values(spark, ["http://example.com/"], U.page_key)[0]
    assert len(key) == 16
    assert values(spark, [f"{key}.md", "readme.md", None], U.is_page_file) == [True, False, None]


def test_effective_length(spark):
    assert values(spark, ["[link](http://example.com) text", ""], X.effective_length) == [len("link text"), 0]


def test_tokens(spark):
    assert values(spark, ["", "abc", "a" * 9, None], X.estimated_tokens) == [0, 1, 2, 0]


def test_repetitive(spark):
    assert values(spark, ["=====\n=====\n=====\n=====", "a normal line\nand more", "", "--\ntext that goes on and on"], X.is_repetitive) == [True, False, False, False]


def test_clean_lines(spark):
    text = "[a](b)\nkeep\nBack to top\n[**x**](y)\nuid [ unknown ] z\n[en] [a](b) [de] [c](d)\nlast"
    assert values(spark, [text], X.clean_lines) == ["keep\nlast"]


def test_modes(spark):
    assert values(spark, ["a.MD", "b.htm", "c.xyz", "d", "x.y/z"], X.processing_mode) == ["markdown/text", "html", *["unknown_fallback_raw"] * 3]


def test_escape_html(spark):
    assert values(spark, ["<a href=\"x\">&'</a>\n"], X.html_paragraph) == ["<p>&lt;a href=&quot;x&quot;&gt;&amp;&#x27;&lt;/a&gt;<br></p>"]


def test_readable_text():
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav>Home</nav><header>Site Title</header>
      <main><article><h1>Head</h1><p>One <b>two</p><script>var t="</p>";</script><p>three</article></main><footer>© 2024</footer></body></html>"""
    assert readable_text(page) == "Head\nOne\ntwo\nthree"
    assert readable_text("<body><p>Directly.</p><div>More.</div></body>") == "Directly.\nMore."
    assert readable_text("plain") == "plain"
    assert readable_text("<div class='x content'>in</div><div>out</div>") == "in"


def test_split_bounds():
    text = "# T\n\nA paragraph with words. Another one!\n\n- item one\n- item two\n" * 5
    chunks = S.split_text(text, 30, 5)
    assert len(chunks) > 1 and all(0 < len(c) <= 30 for c in chunks)
    assert "".join("".join(S.split_text(text, 30, 0)).split()) == "".join(text.split())
    assert S.split_text("x" * 25, 10, 0) == ["x" * 10, "x" * 10, "x" * 5]
    assert S.split_text("", 10, 0) == []
    assert S.clamp_overlap(20, 30) == 5 and S.clamp_overlap(20, 5) == 5
    assert S.engine_limits(0, 9, -1) == (1, 0, 0)
