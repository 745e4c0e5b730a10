import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import content, html, text, urls


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in rows.select("i", f(F.col("v"))).orderBy("i").collect()]


def test_unsafe_hrefs(spark):
    given_ = [None, "", "javascript:alert(1)", " JavaScript:void(0)", "data:text/html,x", "VBScript:msgbox", "https://example.com", "/path", "#top"]
    assert column(spark, given_, text.is_unsafe_href) == [False, False, True, True, True, True, False, False, False]


def test_load_more_labels(spark):
    given_ = ["Load more", "  SHOW\n all ", "view all posts", "Read more", "read more »", "x" * 100, None, "", "preload moreover", "Load more " + "x" * 80]
    assert column(spark, given_, text.is_load_more) == [True, True, True] + [False] * 7


def test_rules_in_order(spark):
    long = "w" * 100
    rows = [
        ("404 error", "short", ""), ("Terror", long, ""), ("Please sign  in", long, ""), ("Login404", long, ""), ("xlogin", long, ""), ("fine", long, f"<a>{'y' * 60}</a>"),
        ("fine", long, f"<a>{'y' * 61}</a>"), ("fine", "w" * 99, ""), ("é login", long, ""), ("", "", ""),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, p string, h string")
    got = [r[0] for r in df.select(text.rule_reason(F.col("t"), F.col("p"), F.col("h"))).collect()]
    short = text.TOO_SHORT % 100
    assert got == [short, text.ERROR_PAGE, text.LOGIN_WALL, text.ERROR_PAGE, None, None, text.NAVIGATION, short, text.LOGIN_WALL, short]


def test_white_space_as_in_browsers(spark):
    assert column(spark, ["a   b﻿", "　x "], text.collapse) == ["a b", "x"]
    assert column(spark, ["a\n \n\n\n b   c \n\td"], text.tidy_html) == ["a\n\nb c\nd"]
    assert column(spark, ["<br><br/><BR ><p> </p><div>\n</div>x"], text.tidy_epub) == ["<br><BR >x"]
    assert column(spark, ["<a b=\"c\">'&amp;"], text.escape_html) == ["&lt;a b=&quot;c&quot;&gt;&#039;&amp;amp;"]


def test_style_sheets(spark):
    good = "body{a:b} .toc{a:b} .chapter{a:b} h1{a:b} h2{a:b}" + " " * 10 + "p{margin:0 auto;padding:0}" * 3
    bad = [good[:60], good.replace("body", "bod"), good + "}", "@import 'x';" + good, good + "q{a:url( 'file:///x')}", good + "<", good + "```", None]
    assert column(spark, [good, good + "q{a:url(https://x/y)}", *bad], text.css_is_valid) == [True, True] + [False] * len(bad)
    assert column(spark, ["```CSS\nbody{}\n```"], text.strip_fences) == ["body{}"]


def test_titles_and_models(spark):
    given_ = ["https://www.example.com/x", "http://blog.site.org", "nonsense", None, "https://my.www.host.com/"]
    assert column(spark, given_, text.book_title) == ["Example Collection", "Blog Collection", "Blog Collection", "Blog Collection", "My Collection"]
    assert column(spark, ["openai", "anthropic", "gemini"], text.default_model) == ["gpt-4o-mini", "claude-haiku-4", "gemini-2.0-flash"]


def test_blocked_requests(spark):
    df = spark.createDataFrame([("https://x/a", "image"), ("https://x/downloads", "document"), ("https://x/a", "document"), ("https://WWW.Facebook.com/", "script")], "u string, k string")
    assert [r[0] for r in df.select(text.is_blocked(F.col("u"), F.col("k"))).collect()] == [True, True, False, True]


BASE = "https://Example.com:443/blog/post/?q=1#f"


@pytest.mark.parametrize(
    ("href", "want"),
    [
        ("/a/../b/./c", "https://example.com/b/c"), ("x.html", "https://example.com/blog/post/x.html"), ("//Other.ORG:80/z", "https://other.org:80/z"), ("http://H:80", "http://h/"), ("?z=2", "https://example.com/blog/post/?z=2"),
        ("#top", "https://example.com/blog/post/?q=1#top"), ("", "https://example.com/blog/post/?q=1"), ("/é b", "https://example.com/%C3%A9%20b"), ("mailto:A@b.c", "mailto:A@b.c"), ("http://", None), ("http://a b/", None),
        (" \n/tab\tbed ", "https://example.com/tabbed"), ("https:rel", "https://example.com/blog/post/rel"), ("..", "https://example.com/blog/"), ("\\x\\y", "https://example.com/x/y"), ("http://münchen.de/", "http://xn--mnchen-3ya.de/"), (None, None), ("http://h:99999/", None),
    ],
)
def test_addresses(href, want):
    assert urls.resolve(href, BASE) == want


def test_article_links(spark):
    base = "https://blog.example.com/start"
    yes = ["https://blog.example.com/2020/01/02/x", "http://blog.example.com:8080/hello?a=1", "https://blog.example.com/blog/", "https://blog.example.com/a/b/"]
    no = [f"https://blog.example.com/{s}-x" for s in urls.DENY_STEMS] + ["https://blog.example.com/x.PDF", "https://blog.example.com/", "https://www.blog.example.com/x", "mailto:x@blog.example.com", "https://blog.example.com/a//", None]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(yes + no)], "i int, u string")
    got = [r[0] for r in df.orderBy("i").select(urls.is_article_link(F.col("u"), F.lit(base))).collect()]
    assert got == [True] * len(yes) + [False] * len(no)


# -- the tree -----------------------------------------------------------------------------------
def test_tolerant_tree():
    root = html.parse("<p><b>open<br><p>next <li>a<li>b</ul><script>var t='</p>';</script>&copy; x &lt; y")
    assert html.inner_html(root) == "<p><b>open<br></b></p><p>next </p><li>a</li><li>b<script>var t='</p>';</script>© x &lt; y</li>"


def test_prune_keeps_chapters_and_emptied_parents():
    page = '<div class="chapter"><header>kept</header></div><header>gone</header><article><header>gone</header>x<p></p><div><span></span></div></article><i id="commentary">gone</i><i class="commentary">kept</i><nav>n</nav><p class="ad x">a</p><em class="my-advert">b</em>'
    root = html.parse(page)
    assert html.prune(root) == 6
    assert html.inner_html(root) == '<div class="chapter"><header>kept</header></div><article>x<div></div></article><i class="commentary">kept</i>'


def test_links_iframes_images():
    root = html.parse('<a href="/x">t<b>u</b></a><a href="#f">v</a><a>w</a>')
    assert html.strip_links(root) == 1 and html.inner_html(root) == 'tu<a href="#f">v</a><a>w</a>'
    root = html.parse('<iframe src="/v"></iframe><iframe src="javascript:x"></iframe><iframe></iframe><iframe src=" "></iframe>')
    html.replace_iframes(root, "https://h/a")
    assert html.inner_html(root) == '<p><strong>[Embedded Media]</strong> <a href="https://h/v" target="_blank" rel="noopener noreferrer">https://h/v</a></p>'
    root = html.parse('<img data-src="a" loading="lazy"><img src="s" data-lazy="z" data-srcset="q">')
    assert html.reveal_images(root) == 3 and 'src="a"' in html.inner_html(root) and "loading" not in html.inner_html(root)
    assert html.absolute_html('<img src="i.png" srcset="x" loading="lazy"><a href="#x">y</a>\n\n\n\n<a href="http://">z</a>', "https://h/p/") == '<img src="https://h/p/i.png"><a href="https://h/p/#x">y</a>\n\n<a href="http://">z</a>'


def test_next_page_in_order_of_priority():
    find = lambda page: html.next_page(html.parse(page), "https://h/1")
    assert find('<a href="/t">Next page</a><link rel="next" href="/l"><a rel="next" href="/r">x</a>') == "https://h/r"
    assert find('<div class="pagination"><a href="/2">2</a><a href="/3">3</a></div>') == "https://h/3"
    assert find('<a href="/n">nextdoor</a><a href="/m"> next\n»</a>') == "https://h/m"
    assert find('<button aria-label="Next">x</button>') is None


def test_load_more_target():
    find = lambda page: html.load_more_target(html.parse(page))
    assert find('<button>Load more</button><main><a href="javascript:x">show all</a><a href="/y">View  all posts</a><p>see more</p></main>') == "View all posts"
    assert find('<div role="button">Expand</div><a>show more</a>') == "Expand"
    assert find("<article>x</article><button>Load more</button>") is None


def test_readable_article():
    body = "".join(f"<p>Sentence number {i}, which says something, at some length, about the matter.</p>" for i in range(8))
    page = f'<html lang="en"><head><title>A long story | Site</title><meta name="author" content="A. Writer"><meta property="og:site_name" content="Site"></head><body><nav>menu</nav><div class="links">{"<a href=/x>link text here</a>" * 30}</div><div id="content" dir="ltr">{body}<a href="/y">z</a></div></body></html>'
    got = content.extract(page)
    assert got["title"] == "A long story" and got["byline"] == "A. Writer" and got["site_name"] == "Site" and got["lang"] == "en" and got["dir"] == "ltr"
    assert "Sentence number 7" in got["text_content"] and "link text here" not in got["text_content"] and got["length"] == len(got["text_content"])
    art = content.extract_article(page, "https://h/a")
    assert "<a" not in art["content_html"] and "Sentence number 0" in art["content_html"]
    assert content.extract("<html><body></body></html>") is None


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/abp \n\t=\"'!-&;#", max_size=60))
def test_any_input_parses_and_settles(s):
    once = html.inner_html(html.parse(s))
    html.prune(html.parse(s))
    content.readable(html.parse(s))
    assert isinstance(once, str)
    assert html.tidy(html.tidy(s)) == html.tidy(s)


def test_one_walk_prunes_as_the_selectors_in_turn():
    import random

    from quire.functions import html

    def in_turn(root):
        n = 0
        for fits in [html.selector(s) for s in html.NON_CONTENT]:
            for e in [e for e in root.walk() if fits(e)]:
                e.remove()
                n += 1
        for e in [e for e in root.find("p", "div", "span") if not [k for k in e.kids if not isinstance(k, html.Comment)]]:
            e.remove()
        return n

    rng = random.Random(3)
    marks = ["", ' class="ad"', ' class="x advert-y"', ' class="chapter"', ' id="comments"', ' id="mycomment"', ' class="social-links popup"', ' class="related-posts cookie"', ' class="overlay"', ' id="respond" class="modal"']
    for _ in range(300):
        out = ""
        for _ in range(rng.randint(1, 14)):
            tag = rng.choice(["div", "section", "nav", "footer", "header", "aside", "span", "p", "ul"])
            out += f"<{tag}{rng.choice(marks)}>" + rng.choice(["", "t", "<!--c-->"]) + rng.choice(["", "", f"</{tag}>", f"</{tag}></div>"])
        a, b = html.parse(out), html.parse(out)
        assert (html.prune(a), html.inner_html(a)) == (in_turn(b), html.inner_html(b)), out
