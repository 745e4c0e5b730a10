"""Main content of hand-made pages whose main text is known, word by word."""

import random
import re
import time

import pytest

from quire.functions import content, html

rng = random.Random(20)
WORDS = ["".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(2, 9))) for _ in range(900)]


def prose(tag, n=60):
    """n words that carry a tag, so that each is known by where it stands."""
    words = [f"{rng.choice(WORDS)}{tag}" for _ in range(n)]
    for i in range(6, n - 1, 9):
        words[i] += ","
    return " ".join(words).capitalize() + "."


def paragraphs(k, tag="m", n=60):
    return "".join(f"<p>{prose(tag, n)}</p>" for _ in range(k))


def links(k, tag="x"):
    return "".join(f'<li><a href="/{i}">{prose(tag, 6)}</a></li>' for i in range(k))


#: name: (page, least precision, least recall) over words that end in m (main) and x (not).
PAGES = {
    "article among lists": f'<div class="links"><ul>{links(30)}</ul></div><article><h2>{prose("m", 5)}</h2>{paragraphs(6)}</article><div><ul>{links(20)}</ul></div>',
    "no class at all": f"<div><div>{links(25)}</div><div>{paragraphs(5)}</div><div><p>{prose('x', 12)}</p></div></div>",
    "paragraphs in the body": f"<p><a href='/'>{prose('x', 4)}</a></p>{paragraphs(7)}<p><a href='/n'>{prose('x', 4)}</a></p>",
    "spread over sections": "".join(f"<section><h3>{prose('m', 4)}</h3>{paragraphs(2)}</section>" for _ in range(5)),
    "intro beside the body": f'<div id="w"><p>{prose("m", 40)}</p><div class="text">{paragraphs(6)}</div><p>{prose("m", 30)}</p><ul>{links(15)}</ul></div>',
    "div soup with breaks": f"<div>{prose('m', 90)}<br><br>{prose('m', 90)}<br>{prose('m', 80)}</div><div><a href='/1'>{prose('x', 10)}</a> <a href='/2'>{prose('x', 10)}</a></div>",
    "named furniture": f'<div class="promo"><p>{prose("x", 50)}</p><p>{prose("x", 50)}</p></div><div class="post-body">{paragraphs(5)}</div><div id="footer-links"><p>{prose("x", 40)}</p></div>',
    "furniture by role": f'<div role="complementary">{paragraphs(3, "x")}</div><div>{paragraphs(6)}</div><div role="dialog"><p>{prose("x", 60)}</p></div>',
    "hidden parts": f'<article>{paragraphs(4)}<div style="display: none">{paragraphs(2, "x")}</div><p hidden>{prose("x", 50)}</p><div aria-hidden="true">{paragraphs(1, "x")}</div></article>',
    "link block inside": f'<article>{paragraphs(3)}<div class="box"><p>{prose("x", 3)}</p><ul>{links(12)}</ul></div>{paragraphs(3)}</article>',
    "form inside": f'<article>{paragraphs(3)}<div><form><input><input><p>{prose("x", 8)}</p><button>{prose("x", 2)}</button></form></div>{paragraphs(2)}</article>',
    "lists of prose stay": f"<article>{paragraphs(3)}<ul>{''.join(f'<li>{prose("m", 15)}</li>' for _ in range(8))}</ul>{paragraphs(2)}</article>",
    "tables of data stay": f"<article>{paragraphs(3)}<table><tr><th>{prose('m', 1)}</th><th>{prose('m', 1)}</th></tr>{''.join(f'<tr><td>{prose("m", 2)}</td><td>{prose("m", 2)}</td></tr>' for _ in range(6))}</table>{paragraphs(2)}</article>",
    "code and quotes stay": f"<article>{paragraphs(3)}<pre><code>{prose('m', 30)}</code></pre><blockquote><p>{prose('m', 30)}</p></blockquote>{paragraphs(2)}</article>",
    "figure with caption": f'<article>{paragraphs(3)}<figure><img src="/a.png"><figcaption>{prose("m", 9)}</figcaption></figure>{paragraphs(2)}</article>',
    "table layout": f"<table><tr><td><ul>{links(15)}</ul></td><td>{paragraphs(6)}</td></tr></table>",
    "short page": f"<div><ul>{links(8)}</ul></div><article><p>{prose('m', 20)}</p></article>",
    "all named as furniture": f'<div class="widget"><div class="sidebar-box">{paragraphs(3)}</div></div>',
    "left open": f"<div><ul>{links(20)}<article><p><b>{prose('m', 30)}<br><p>{prose('m', 50)}<p>{prose('m', 50)}<p>{prose('m', 60)}</article>",
    "one long comment list": f'<article>{paragraphs(6)}</article><div class="replies">{"".join(f"<div><p>{prose("x", 7)}</p></div>" for _ in range(20))}</div>',
}


def told(page):
    got = content.extract(f"<html><head><title>Title of it</title></head><body>{page}</body></html>")
    return got and got["text_content"]


def words(text, tag):
    return re.findall(rf"\b\w+{tag}\b", text)


@pytest.mark.parametrize("name", PAGES)
def test_finds_the_main_text(name):
    text = told(PAGES[name])
    main = words(re.sub("<[^>]*>", " ", PAGES[name]), "m")
    kept, noise = words(text, "m"), words(text, "x")
    precision, recall = len(kept) / max(1, len(kept) + len(noise)), len(kept) / len(main)
    assert precision >= 0.97 and recall >= 0.99, (precision, recall)
    assert kept == [w for w in main if w in set(kept)] or len(kept) == len(main)  # in order


def test_nothing_but_links_and_nothing_at_all():
    assert told("") is None and told("<div> <p></p></div>") is None and told("<img src='/x.png'>") is None
    assert "x" in told(f"<ul>{links(3)}</ul>")  # the least strict attempt keeps what there is


def test_title_is_not_repeated():
    page = f"<html><head><title>The long way home | Site</title></head><body><article><h1>The long way home</h1>{paragraphs(4)}<h2>The long way home</h2></article></body></html>"
    got = content.extract(page)
    assert got["title"] == "The long way home" and got["content"].count("The long way home") == 1


def test_attempts_loosen_in_order():
    """A page of little text takes the attempt that has most, the strictest of equals."""
    page = html.parse(f'<body><div class="promo"><p>{prose("m", 30)}</p></div><p>{prose("m", 12)}</p></body>')
    assert len(words(content.main_content(html.body(page)).text(), "m")) == 42
    rules = content.LADDER
    assert [(r.unlikely, r.weigh, r.clean) for r in rules] == [(True, True, True), (False, True, True), (False, False, True), (False, False, False)]


def test_fields():
    page = f'<html lang="fr"><head><meta property="og:title" content="T t t"><meta name="description" content="D"></head><body><article dir="rtl"><p class="byline">By A. Writer</p>{paragraphs(5)}</article></body></html>'
    got = content.extract(page)
    assert (got["title"], got["excerpt"], got["lang"], got["dir"], got["byline"]) == ("T t t", "D", "fr", "rtl", "By A. Writer")
    assert got["length"] == len(got["text_content"]) and got["content"].startswith('<div id="readability-page-1" class="page">')


@pytest.mark.parametrize("page", [paragraphs(1) + "<p>a b c, d e f.</p>" * 20_000, "<div>" * 3000 + paragraphs(3) + "</div>" * 3000, "<article>" + "<a href='/x'>y</a>" * 20_000 + paragraphs(9) + "</article>", "<div class='ad'>x</div>" * 20_000 + paragraphs(4)])
def test_time_is_linear_in_elements(page):
    began = time.perf_counter()
    assert content.extract_article(page, "https://h/a")["content_html"]
    assert time.perf_counter() - began < 12
