"""The library's own queries by name, and the same in SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import html, text, urls
from quire.operators import assemble, discover, extract, filtering, metadata
from quire.plans import layout
from quire.sources import pages as captured
from quire.sources import sinks
from quire.sources.staging import claimed
from quire.streaming import ordered
from quire.streaming.frontier import Frontier
from quire.streaming.pages import stability

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return captured.read_pages(spark, f"{d}/pages.parquet")


def _articles(spark: SparkSession, d: str) -> DataFrame:
    return captured.flat_articles(_pages(spark, d))


def _classified(spark: SparkSession, d: str) -> DataFrame:
    return filtering.classify(_articles(spark, d), flat=True)


# -- pieces of SQL -----------------------------------------------------------------------------
def _read(x: str) -> str:
    for name, char in (("&lt", "<"), ("&gt", ">"), ("&quot", '"'), ("&#039", "''"), ("&copy", "©"), ("&middot", "·"), ("&nbsp", "\u00a0"), ("&amp", "&")):
        x = f"regexp_replace({x}, '{name};?', '{char}', 'g')"
    return x


def _escape(x: str) -> str:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#039;")):
        x = f"replace({x}, '{char}', '{name}')"
    return x


def _flat(x: str) -> str:
    return f"trim(regexp_replace({_read(f"regexp_replace({x}, '<[^>]*>', '', 'g')")}, '\\s+', ' ', 'g'))"


def _host(x: str) -> str:
    return f"lower(regexp_extract({x}, '^[A-Za-z]+://([^/?#:]*)', 1))"


_RULES = f"""WHEN length(plain) < 100 THEN '{text.TOO_SHORT % 100}'
        WHEN regexp_matches(trim(title), '(?i)(404|not\\s+found|access\\s+denied|forbidden|error)') THEN '{text.ERROR_PAGE}'
        WHEN regexp_matches(trim(title), '(?i)\\b(login|sign\\s*in|sign\\s*up|register)\\b') THEN '{text.LOGIN_WALL}'
        WHEN length(plain) > 0 AND link_ratio > 0.6 THEN '{text.NAVIGATION}'"""
_BASE = f"""
WITH a AS (
    SELECT {_host("url")} AS book_id, page_id AS seq, url, {_read("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title,
           regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS content_html FROM pages
), b AS (
    SELECT *, {_flat("content_html")} AS plain FROM a
), c AS (
    SELECT *, sha256(lower(plain)) AS content_hash, row_number() OVER (PARTITION BY book_id ORDER BY seq) AS n,
           coalesce(list_sum(list_transform(regexp_extract_all(content_html, '(?is)<a\\b[^>]*>(.*?)</a>', 1), lambda x: length({_read("regexp_replace(x, '<[^>]*>', '', 'g')")}))), 0)::DOUBLE / greatest(1, length(plain)) AS link_ratio FROM b
), d AS (
    SELECT *, min(CASE WHEN n <= 100 AND length(plain) > 0 THEN n END) OVER (PARTITION BY book_id, content_hash) AS first FROM c
), e AS (
    SELECT * REPLACE (coalesce(nullif(title, ''), '{text.UNTITLED}') AS title), CASE
        WHEN n <= 100 AND length(plain) > 0 AND n > first THEN '{text.DUPLICATE}'
        {_RULES} END AS reason FROM d
), k AS (
    SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY seq) AS chapter FROM e WHERE reason IS NULL
)
"""
_TIDY = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '\\n\\s*\\n\\s*\\n', chr(10) || chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n[ \\t]+', chr(10), 'g'), '[ \\t]{2,}', ' ', 'g'))"
_EPUB = f"trim(regexp_replace(regexp_replace(regexp_replace({_TIDY}, '(?i)<br\\s*/?>\\s*<br\\s*/?>', '<br>', 'g'), '(?i)<p>\\s*</p>', '', 'g'), '(?i)<div>\\s*</div>', '', 'g'))"


# -- scalar rules over pages -------------------------------------------------------------------
@query(_BASE + "SELECT seq AS page_id, plain, length(plain)::BIGINT AS n_chars FROM b")
def plain_text(spark, d):
    return _articles(spark, d).select(F.col("seq").alias("page_id"), "plain", F.length("plain").cast("long").alias("n_chars"))


@query(_BASE + "SELECT seq AS page_id, content_hash FROM c")
def content_hash(spark, d):
    return _articles(spark, d).select(F.col("seq").alias("page_id"), text.content_hash(F.col("plain")).alias("content_hash"))


@query(f"SELECT page_id, {_TIDY} AS tidy FROM pages")
def clean_whitespace(spark, d):
    return _pages(spark, d).select("page_id", text.tidy_html(F.col("html")).alias("tidy"))


@query(f"SELECT page_id, {_EPUB} AS tidy FROM pages")
def clean_epub(spark, d):
    return _pages(spark, d).select("page_id", text.tidy_epub(F.col("html")).alias("tidy"))


@query(_BASE + f"SELECT seq AS page_id, {_escape('title')} AS escaped FROM b")
def escape_title(spark, d):
    return _articles(spark, d).select(F.col("seq").alias("page_id"), text.escape_html(F.col("title")).alias("escaped"))


@query(_BASE + "SELECT seq AS page_id, round(link_ratio, 9) AS link_ratio FROM c")
def link_ratio(spark, d):
    return _articles(spark, d).select(F.col("seq").alias("page_id"), F.round(text.link_ratio(F.col("content_html"), F.col("plain")), 9).alias("link_ratio"))


@query(f"SELECT page_id, CASE WHEN {_host('url')} = '' THEN 'Blog Collection' ELSE upper(left(split_part(regexp_replace({_host('url')}, '^(.*?)www\\.', '\\1'), '.', 1), 1)) || substr(split_part(regexp_replace({_host('url')}, '^(.*?)www\\.', '\\1'), '.', 1), 2) || ' Collection' END AS title FROM pages")
def title_from_url(spark, d):
    return _pages(spark, d).select("page_id", text.book_title(F.col("url")).alias("title"))


@query(r"""SELECT conv_id, turn, coalesce(t <> '' AND length(t) <= 80 AND regexp_matches(t, '(?i)\b(load more|show more|show all|expand|see more|view all)\b'), false) AS is_load_more
FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations)""")
def load_more_labels(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet")
    return rows.select("conv_id", "turn", text.is_load_more(F.col("text")).alias("is_load_more"))


@query(r"""SELECT page_id, pos, href, regexp_matches(trim(href), '(?i)^(javascript|data|vbscript):') AS unsafe FROM (
SELECT page_id, unnest(l) AS href, generate_subscripts(l, 1)::INT - 1 AS pos FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["'']([^"''>]*)["'']', 1) AS l FROM pages)) WHERE trim(href) <> ''""")
def unsafe_hrefs(spark, d):
    return discover.anchors(_pages(spark, d)).select("page_id", "pos", "href", text.is_unsafe_href(F.col("href")).alias("unsafe"))


_CSS = "replace('body{margin:0} .toc{padding:1em} .toc-list{margin:0} .chapter{color:#111} h1{font-size:2em} p{margin:0}', 'p{margin:0}', coalesce(regexp_extract(html, '(?s)<style>(.*?)</style>', 1), ''))"


@query(f"""SELECT page_id, length(trim(css)) >= 100 AND NOT contains(css, '<') AND NOT contains(css, '```') AND contains(css, 'body') AND contains(css, '.toc') AND contains(css, '.chapter')
AND length(css) - length(replace(css, '{{', '')) = length(css) - length(replace(css, '}}', '')) AND length(css) - length(replace(css, '{{', '')) >= 5 AND NOT regexp_matches(css, '(?i)@import\\b')
AND NOT regexp_matches(css, '(?i)url\\s*\\(\\s*[''"]?\\s*(file:|data:|javascript:|vbscript:|chrome:|chrome-extension:)') AS valid FROM (SELECT page_id, {_CSS} || repeat('}}', (page_id % 2)::INT) AS css FROM pages)""")
def css_valid(spark, d):
    """Sheets made of the pages' own rules, every second one with a stray brace."""
    base = "body{margin:0} .toc{padding:1em} .toc-list{margin:0} .chapter{color:#111} h1{font-size:2em} p{margin:0}"
    own = F.regexp_extract("html", r"(?s)<style>(.*?)</style>", 1)
    css = F.concat(F.replace(F.lit(base), F.lit("p{margin:0}"), own), F.expr("repeat('}', cast(page_id % 2 as int))"))
    return _pages(spark, d).select("page_id", text.css_is_valid(css).alias("valid"))


_KIND = "CASE page_id % 4 WHEN 0 THEN 'document' WHEN 1 THEN 'image' WHEN 2 THEN 'script' ELSE 'xhr' END"


@query(f"SELECT page_id, resource_type, resource_type IN {text.BLOCKED_TYPES} OR {' OR '.join(f"contains(lower(url), '{t}')" for t in text.BLOCKED_TOKENS)} AS blocked FROM (SELECT page_id, url, {_KIND} AS resource_type FROM pages)")
def blocked_requests(spark, d):
    rows = _pages(spark, d).withColumn("resource_type", F.expr(_KIND))
    return rows.select("page_id", "resource_type", text.is_blocked(F.col("url"), F.col("resource_type")).alias("blocked"))


@query(f"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/embed/' || page_id END AS safe FROM pages")
def safe_iframe(spark, d):
    """Embeds with a relative, a script and a data address."""
    src = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" /embed/"), F.col("page_id").cast("string"))).when(F.col("page_id") % 3 == 1, F.lit("JavaScript:alert(1)")).otherwise(F.lit("data:text/html,x"))
    return _pages(spark, d).select("page_id", urls.safe_media_url(src, F.col("url")).alias("safe"))


# -- filtering ---------------------------------------------------------------------------------
@query(_BASE + "SELECT book_id, seq, title, length(plain)::BIGINT AS n_chars, content_hash, reason FROM e")
def rule_filter(spark, d):
    return _classified(spark, d).select("book_id", "seq", "title", F.length("plain").cast("long").alias("n_chars"), "content_hash", "reason")


@query(_BASE + "SELECT book_id, seq, chapter, url, title FROM k")
def rule_filter_kept(spark, d):
    return assemble.numbered(filtering.kept(_classified(spark, d))).select("book_id", "seq", "chapter", "url", "title")


@query(_BASE + "SELECT book_id, seq, url, title, reason FROM e WHERE reason IS NOT NULL")
def rule_filter_omitted(spark, d):
    return filtering.omitted(_classified(spark, d))


@query(_BASE + "SELECT book_id, reason, count(*) AS pages FROM e WHERE reason IS NOT NULL GROUP BY ALL")
def omission_counts(spark, d):
    return filtering.omission_counts(_classified(spark, d))


@query(_BASE + "SELECT book_id, count(*) AS extracted, count(reason) AS omitted, count(*) - count(reason) AS kept FROM e GROUP BY book_id")
def run_counts(spark, d):
    return filtering.run_counts(_classified(spark, d))


_DOCS = r"""WITH p AS (SELECT coalesce(source, '') AS book_id, doc_id AS seq, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS plain FROM documents),
q AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY seq) AS n, sha256(lower(plain)) AS h FROM p),
r AS (SELECT *, min(CASE WHEN n <= 100 AND length(plain) > 0 THEN n END) OVER (PARTITION BY book_id, h) AS first FROM q) """


@query(_DOCS + "SELECT book_id, seq, coalesce(n <= 100 AND length(plain) > 0 AND n > first, false) AS duplicate, length(plain) < 100 AS short FROM r")
def dedup_first100(spark, d):
    """Documents as articles, a book per source: capped duplicates and the length rule."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = docs.select(F.coalesce("source", F.lit("")).alias("book_id"), F.col("doc_id").alias("seq"), text.collapse(F.coalesce("text", F.lit(""))).alias("plain"), F.lit("").alias("title"), F.lit("").alias("content_html"))
    rows = filtering.classify(rows, filtering.FilterOptions(0, False, False), flat=True)
    return rows.select("book_id", "seq", F.col("reason").isNotNull().alias("duplicate"), (F.length("plain") < 100).alias("short"))


@query(_BASE + "SELECT book_id, seq, (n - 1) // 10 AS batch, (n - 1) % 10 AS pos FROM c")
def filter_batches(spark, d):
    return filtering.batches(_articles(spark, d)).select("book_id", "seq", "batch", "pos")


@query(_BASE + """SELECT book_id, (n - 1) // 10 AS batch, (n - 1) % 10 AS pos, ((n - 1) % 10 + 1)::VARCHAR || '. Title: "' || trim(regexp_replace(title, '\\s+', ' ', 'g')) || '" | URL: ' || url || ' | Length: ' || length(plain)::VARCHAR || ' chars | Snippet: "' || left(plain, 200) || '"' AS line FROM e""")
def prompt_lines(spark, d):
    return filtering.prompt_lines(_articles(spark, d))


_REPLY = "CASE conv_id % 4 WHEN 0 THEN '[{\"include\": true}]' WHEN 1 THEN '```json\\n[{\"include\": false, \"reason\": \"thin\"}]\\n```' WHEN 2 THEN '[{\"include\": \"yes\"}]' ELSE 'none' END"


@query("SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END AS include, CASE conv_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'thin' END AS reason FROM conversations")
def parse_decisions(spark, d):
    """Replies of four kinds: bare, fenced, not boolean, not JSON."""
    rows = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.expr(_REPLY).alias("raw"), F.lit(1).alias("expected"))
    got = filtering.decisions(rows)
    return got.select("conv_id", "turn", F.col("decisions")[0]["include"].cast("string").alias("include"), F.col("decisions")[0]["reason"].alias("reason"))


def _stub(prompt: str) -> str:
    """Leaves out articles whose line has an odd length; fails on batches of three."""
    import json

    lines = [x for x in prompt.split("\n") if x[:1].isdigit()]
    return "none" if len(lines) == 3 else json.dumps([{"include": len(x) % 2 == 0, "reason": "odd"} for x in lines])


_LINE = """pos || '. Title: "' || trim(regexp_replace(title, '\\s+', ' ', 'g')) || '" | URL: ' || url || ' | Length: ' || length(plain)::VARCHAR || ' chars | Snippet: "' || left(plain, 200) || '"'"""


@query(_BASE + f""", t AS (SELECT *, (n - 1) // 10 AS batch, (n - 1) % 10 + 1 AS pos, count(*) OVER (PARTITION BY book_id, (n - 1) // 10) AS size FROM e),
u AS (SELECT *, {_LINE} AS line, min(CASE WHEN length(plain) > 0 THEN pos END) OVER (PARTITION BY book_id, batch, content_hash) AS own FROM t)
SELECT book_id, seq, title, CASE WHEN size <> 3 AND length(line) % 2 = 0 THEN NULL WHEN size <> 3 THEN 'odd' WHEN length(plain) > 0 AND pos > own THEN '{text.DUPLICATE}' {_RULES} END AS reason FROM u""")
def ai_filter_stub(spark, d):
    return filtering.judged(_articles(spark, d), _stub).select("book_id", "seq", "title", "reason")


# -- discovery ---------------------------------------------------------------------------------
_ANCHORS = r"""WITH x AS (SELECT page_id, url, regexp_extract_all(html, '(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["'']([^"''>]*)["'']', 1) AS l FROM pages),
y AS (SELECT page_id, url, unnest(l) AS href, generate_subscripts(l, 1)::INT - 1 AS pos FROM x),
z AS (SELECT * FROM y WHERE trim(href) <> ''),
f AS (SELECT page_id, pos, """ + _host("url") + r""" AS book_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || array_to_string(list_transform(string_split(trim(href), ''), lambda c: CASE WHEN unicode(c) > 126 OR c IN (' ', '"', '<', '>', '`', '{', '}') THEN url_encode(c) ELSE c END), '') AS href FROM z),
g AS (SELECT *, lower(regexp_extract(href, '^https?://[^/?#]+([^?#]*)', 1)) AS path FROM f),
h AS (SELECT book_id, page_id, pos, regexp_replace(href, '#.*$', '') AS href FROM g WHERE NOT regexp_matches(path, '/(author|user|profile|about|contact|privacy|terms|tag|category|archive|page|search|login|signup|register|account|dashboard|feed|rss|api|wp-json|wp-admin)|\.(jpg|jpeg|png|gif|pdf|zip|xml)$|^/$') AND regexp_matches(path, '/\d{4}/\d{2}/\d{2}/|/blog/|/post/|/article/|/[^/]+/?$')),
s AS (SELECT book_id, href, row_number() OVER (PARTITION BY book_id ORDER BY min(page_id * 1048576 + pos), href) AS seq FROM h GROUP BY book_id, href) """


@query(_ANCHORS + "SELECT page_id, pos, href FROM z")
def anchor_explode(spark, d):
    return discover.anchors(_pages(spark, d)).select("page_id", "pos", "href")


@query(_ANCHORS + "SELECT book_id, page_id, pos, href FROM h")
def article_links(spark, d):
    return discover.article_links(_pages(spark, d))


@query(_ANCHORS + f""", q AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\\s[^>]*>(.*?)</a>', 1) AS l FROM pages),
r AS (SELECT page_id, unnest(l) AS label, generate_subscripts(l, 1)::INT - 1 AS pos FROM q)
SELECT f.page_id, f.pos, f.href, {_flat("label")} AS label FROM f JOIN r USING (page_id, pos)""")
def tree_anchors(spark, d):
    """Every anchor by the tree: place, absolute address, label."""
    return discover.tree_links(_pages(spark, d)).select("page_id", F.inline("anchors"))


@query(_ANCHORS + "SELECT book_id, seq, href FROM s")
def links_first_seen(spark, d):
    return discover.first_seen(discover.article_links(_pages(spark, d)))


@query(_ANCHORS + "SELECT book_id, seq, href FROM s WHERE seq <= 10")
def top_links_per_host(spark, d):
    return discover.limit_per_book(discover.first_seen(discover.article_links(_pages(spark, d))))


@query(_ANCHORS + """, u AS (SELECT book_id, href, seq AS place FROM s WHERE seq <= 4 UNION ALL SELECT book_id, href, 1048576 + seq FROM s),
v AS (SELECT book_id, href, min(place) AS place FROM u GROUP BY book_id, href) SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY place, href) AS seq, href FROM v""")
def union_of_snapshots(spark, d):
    links = discover.first_seen(discover.article_links(_pages(spark, d)))
    return discover.union_links(links.where("seq <= 4"), links)


@query(f"""WITH m AS (SELECT url, min(page_id) AS page_id FROM pages GROUP BY url)
SELECT {_host("url")} AS book_id, row_number() OVER (PARTITION BY {_host("url")} ORDER BY page_id, url) AS seq, url, sha256(html) AS page FROM m JOIN pages USING (url, page_id)""")
def lookup_page(spark, d):
    """The captures of all addresses, each by its address, in order of discovery."""
    pages = _pages(spark, d)
    listed = discover.first_seen(captured.with_book(pages).select("book_id", "page_id", F.lit(0).alias("pos"), F.col("url").alias("href")))
    return captured.fetch(pages, listed).select("book_id", "seq", "url", F.sha2("html", 256).alias("page"))


_CHAIN = f"""WITH RECURSIVE p AS (SELECT {_host("url")} AS book_id, url, page_id, lead(url) OVER w AS next_url, row_number() OVER w AS i FROM pages WINDOW w AS (PARTITION BY {_host("url")} ORDER BY page_id)),
c AS (SELECT book_id, 1::BIGINT AS depth, url, [url] AS seen FROM p WHERE i = 1 UNION ALL
SELECT c.book_id, c.depth + 1, p.next_url, list_append(c.seen, p.next_url) FROM c JOIN p USING (url) WHERE p.next_url IS NOT NULL AND c.depth < 5 AND NOT list_contains(c.seen, p.next_url))
SELECT book_id, depth, url FROM c"""


@query(_CHAIN)
def pagination_chain(spark, d):
    """Each host's pages chained in order of capture, five at most."""
    from pyspark.sql import Window

    w = Window.partitionBy("book_id").orderBy("page_id")
    rows = captured.with_book(_pages(spark, d)).select("book_id", "page_id", "url").withColumn("next_url", F.lead("url").over(w)).withColumn("i", F.row_number().over(w))
    return discover.pagination_chain(rows.where("i = 1").select("book_id", "url"), rows.where("next_url is not null").select("url", "next_url"))


# -- profile and assembly ----------------------------------------------------------------------
def _tags(names: str) -> str:
    return f"sum(len(regexp_extract_all(content_html, '(?i)<({names})\\b')))::BIGINT"


_META = f""", m AS (SELECT book_id, count(*) AS article_count, sum(length(content_html))::BIGINT AS total_characters, floor(avg(length(content_html)) + 0.5)::BIGINT AS avg_article_length, {_tags("pre|code")} AS code_block_count,
{_tags("img")} AS image_count, {_tags("table")} AS table_count, greatest(1, max(list_max(list_transform(regexp_extract_all(content_html, '(?i)<h([1-6])\\b', 1), lambda x: x::BIGINT)))) AS heading_depth, {_tags("ul|ol")} AS list_count,
{_tags("blockquote")} AS blockquote_count, bool_or(length(content_html) > 10000) AS has_long_articles, list(title ORDER BY seq) AS titles FROM k GROUP BY book_id) """


@query(_BASE + _META + "SELECT * EXCLUDE (titles), array_to_string(titles, chr(10)) AS article_titles FROM m")
def content_metadata(spark, d):
    rows = metadata.content_metadata(filtering.kept(_classified(spark, d)))
    return rows.withColumn("article_titles", F.array_join("article_titles", "\n"))


@query(_BASE + _META + """SELECT book_id, left(sha256('{"metadata":' || to_json({'articleCount': article_count, 'totalCharacters': total_characters, 'avgArticleLength': avg_article_length, 'codeBlockCount': code_block_count, 'imageCount': image_count,
'tableCount': table_count, 'headingDepth': heading_depth, 'listCount': list_count, 'blockquoteCount': blockquote_count, 'hasLongArticles': has_long_articles, 'articleTitles': titles})::VARCHAR || ',"provider":"gemini","model":"gemini-2.0-flash"}'), 16) AS cache_key FROM m""")
def metadata_cache_key(spark, d):
    rows = metadata.content_metadata(filtering.kept(_classified(spark, d)))
    return rows.select("book_id", metadata.cache_key(F.lit("gemini"), text.default_model(F.lit("gemini"))).alias("cache_key"))


_TOC = f"""'<div class="toc"><h1>Table of Contents</h1><ul class="toc-list">' || chr(10) || string_agg('<li class="toc-item"><a href="#chapter-' || (chapter - 1) || '"><span class="toc-item-number">' || chapter || '.</span> ' || {_escape("title")} || '</a></li>', chr(10) ORDER BY chapter) || chr(10) || '</ul></div>'"""
_CHAPTERS = f"""string_agg('<div class="chapter" id="chapter-' || (chapter - 1) || '"><h1>' || {_escape("title")} || '</h1>' || chr(10) || content_html || chr(10) || '</div>', chr(10) ORDER BY chapter)"""
# The page head.
_HEAD = '<!DOCTYPE html>\n<html lang="en">\n<head>\n<meta charset="UTF-8">\n<meta name="viewport" content="width=device-width, initial-scale=1.0">\n<title>eBook Collection</title>\n'


@query(_BASE + f"SELECT book_id, {_TOC} AS toc FROM k GROUP BY book_id")
def toc(spark, d):
    return assemble.books(filtering.kept(_classified(spark, d))).select("book_id", "toc")


@query(_BASE + f"SELECT book_id, {_CHAPTERS} AS chapters FROM k GROUP BY book_id")
def chapters(spark, d):
    return assemble.books(filtering.kept(_classified(spark, d))).select("book_id", "chapters")


@query(_BASE + f"SELECT book_id, '{_HEAD}{assemble.STYLE}\n</head>\n<body>\n' || {_TOC} || chr(10) || {_CHAPTERS} || '\n</body>\n</html>' AS master_html FROM k GROUP BY book_id")
def master_html(spark, d):
    return assemble.books(filtering.kept(_classified(spark, d))).select("book_id", "master_html")


@query()
def epub_books(spark, d):
    return assemble.epubs(filtering.kept(_classified(spark, d))).select("book_id", "title", "chapters", F.length("epub").cast("long").alias("bytes"), F.sha2("epub", 256).alias("sha256"))


# -- the tree ----------------------------------------------------------------------------------
@query()
def extracted_articles(spark, d):
    """Every captured page as an article of its host."""
    return extract.articles(captured.with_book(_pages(spark, d)).select("book_id", "seq", "url", "html"))


@query()
def extract_html(spark, d):
    return _pages(spark, d).select("page_id", extract.extracted(F.col("html")).alias("e")).select("page_id", "e.*")


def _edit(name: str, based: bool = False):
    def run(spark, d):
        pages = _pages(spark, d)
        return pages.select("page_id", extract.edited(name, F.col("html"), F.col("url") if based else None).alias("e")).select("page_id", "e.html", F.col("e.n").alias("n"))

    return run


for _name, _edit_name in (("pruned_html", "prune"), ("stripped_links", "strip_links")):
    QUERIES[_name] = _edit(_edit_name)


# The captures hold no such elements, so these edits work on fragments made of the pages' ids and addresses: (name, edit, needs the address, fragment, result, changes).
_ROOT = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
_CASES = (
    ("revealed_images", "reveal_images", False,
     """CASE page_id % 4 WHEN 0 THEN '<img data-src="/a' || page_id || '.png" loading="lazy">' WHEN 1 THEN '<img src="/b.png" data-srcset="/b2.png 2x">' WHEN 2 THEN '<img data-original="/c' || page_id || '.png" data-lazy="/d.png" alt="x &amp; y">' ELSE '<img src="/e.png">' END""",
     """CASE page_id % 4 WHEN 0 THEN '<img data-src="/a' || page_id || '.png" src="/a' || page_id || '.png">' WHEN 1 THEN '<img src="/b.png" data-srcset="/b2.png 2x" srcset="/b2.png 2x">' WHEN 2 THEN '<img data-original="/c' || page_id || '.png" data-lazy="/d.png" alt="x &amp; y" src="/c' || page_id || '.png">' ELSE '<img src="/e.png">' END""",
     "CASE page_id % 4 WHEN 0 THEN 2 WHEN 3 THEN 0 ELSE 1 END"),
    ("styled_code", "style_code", False,
     """'<pre style="a:b">x' || page_id || '<code>y</code></pre><p><code>z</code></p>'""",
     f"""'<pre style="a:b{html.PRE_STYLE}">x' || page_id || '<code>y</code></pre><p><code style="{html.CODE_STYLE}">z</code></p>'""",
     "0"),
    ("iframes_replaced", "replace_iframes", True,
     """CASE page_id % 4 WHEN 0 THEN '<div><iframe src="https://v.example/' || page_id || '?a=1&amp;b=2"></iframe></div>' WHEN 1 THEN '<div><iframe src="JavaScript:x"></iframe></div>' WHEN 2 THEN '<div><iframe></iframe></div>' ELSE '<div><iframe src="/e/' || page_id || '"></iframe></div>' END""",
     f"""CASE page_id % 4 WHEN 0 THEN '<div><p><strong>{html.EMBED_LABEL}</strong> <a href="https://v.example/' || page_id || '?a=1&amp;b=2" target="_blank" rel="noopener noreferrer">https://v.example/' || page_id || '?a=1&amp;b=2</a></p></div>' WHEN 3 THEN '<div><p><strong>{html.EMBED_LABEL}</strong> <a href="' || {_ROOT} || '/e/' || page_id || '" target="_blank" rel="noopener noreferrer">' || {_ROOT} || '/e/' || page_id || '</a></p></div>' ELSE '<div></div>' END""",
     "0"),
    ("stripped_parts", "strip_links", False,
     """'<p>a <a href="/x">b <b>c</b></a> <a href="#s">d</a> <a>e' || page_id || '</a></p>'""",
     """'<p>a b c <a href="#s">d</a> <a>e' || page_id || '</a></p>'""",
     "1"),
    ("pruned_parts", "prune", False,
     """'<div class="x"><nav>n</nav><p></p><div class="social-links">s<div class="ad">q</div></div><section class="chapter"><footer>k</footer></section><footer>f</footer><p>t' || page_id || '</p></div>'""",
     """'<div class="x"><section class="chapter"><footer>k</footer></section><p>t' || page_id || '</p></div>'""",
     "4"),
    ("absolute_parts", "absolutise", True,
     """'<p><a href="/k' || page_id || '">l</a> <img src="/i.png" srcset="x" loading="lazy"> <a href="https://o.example/q">m</a></p>'""",
     f"""'<p><a href="' || {_ROOT} || '/k' || page_id || '">l</a> <img src="' || {_ROOT} || '/i.png"> <a href="https://o.example/q">m</a></p>'""",
     "0"),
)


def _fragments(edit: str, based: bool, fragment: str):
    def run(spark, d):
        pages = _pages(spark, d).select("page_id", "url", F.expr(fragment).alias("html"))
        return pages.select("page_id", extract.edited(edit, F.col("html"), F.col("url") if based else None).alias("e")).select("page_id", "e.html", F.col("e.n").alias("n"))

    return run


for _name, _edit_name, _based, _fragment, _result, _changes in _CASES:
    QUERIES[_name] = _fragments(_edit_name, _based, _fragment)
    ORACLES[_name] = f"SELECT page_id, {_result} AS html, ({_changes})::BIGINT AS n FROM pages"


@query(r"""SELECT conv_id, turn, CASE WHEN t <> '' AND length(t) <= 80 AND regexp_matches(t, '(?i)\b(load more|show more|show all|expand|see more|view all)\b') THEN t END AS label
FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations)""")
def load_more_targets(spark, d):
    """Turns as labels of buttons in content."""
    rows = spark.read.parquet(f"{d}/conversations.parquet")
    page = F.concat(F.lit("<body><button>outside</button><article><p>p</p><button>"), text.escape_html(F.coalesce("text", F.lit(""))), F.lit("</button></article></body>"))
    return rows.select("conv_id", "turn", extract.load_more_target(page).alias("label"))


@query()
def absolute_urls(spark, d):
    return _articles(spark, d).select(F.col("seq").alias("page_id"), extract.absolute(F.col("content_html"), F.col("url")).alias("html"))


@query(_BASE + "SELECT seq AS page_id, plain FROM b")
def tree_plain_text(spark, d):
    """Text by the tree, which must agree with the native expressions on flat articles."""
    return _articles(spark, d).select(F.col("seq").alias("page_id"), extract.plain(F.col("content_html")).alias("plain"))


_BODY = _flat("regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '(?s)<h1>.*?</h1>', '')")


@query(f"SELECT page_id, {_BODY} AS main_text FROM pages")
def main_text(spark, d):
    """The main content of every page without its heading: on these captures, whose lists of links and lines of advertising stand outside, the text of the article element."""
    got = _pages(spark, d).select("page_id", extract.extracted(F.col("html"))["content"].alias("content"))
    return got.select("page_id", extract.plain(F.regexp_replace("content", "(?s)<h1>.*?</h1>", F.lit(""))).alias("main_text"))


_PARTED = "^(.+?)\\s[|\\-–—»/]\\s[^|\\-–—»/]+$"


@query(f"""WITH u AS (SELECT {_host("url")} AS book_id, url, min(page_id) AS page_id FROM pages GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY page_id, url) AS seq FROM u),
t AS (SELECT n.book_id, n.seq, n.url, {_BODY} AS plain, trim(regexp_replace({_read("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}, '\\s+', ' ', 'g')) AS t FROM n JOIN pages p USING (page_id) WHERE n.seq <= 10),
c AS (SELECT *, regexp_extract(t, '{_PARTED}', 1) AS cut, 0.0 AS link_ratio FROM t),
e AS (SELECT *, CASE WHEN len(string_split_regex(trim(cut), '\\s+')) >= 3 THEN cut ELSE t END AS title, min(CASE WHEN length(plain) > 0 THEN seq END) OVER (PARTITION BY book_id, sha256(lower(plain))) AS first FROM c)
SELECT book_id, seq, url, coalesce(nullif(title, ''), '{text.UNTITLED}') AS title, CASE WHEN length(plain) > 0 AND seq > first THEN '{text.DUPLICATE}' {_RULES} END AS reason FROM e""")
def book_pipeline(spark, d):
    """A book per host from its first ten captures: fetch, extract, classify."""
    pages = _pages(spark, d)
    listed = discover.first_seen(captured.with_book(pages).select("book_id", "page_id", F.lit(0).alias("pos"), F.col("url").alias("href")))
    articles = extract.articles(captured.fetch(pages, discover.limit_per_book(listed)))
    return filtering.classify(articles).select("book_id", "seq", "url", "title", "reason")


@query(_ANCHORS + ", start AS (SELECT " + _host("url") + """ AS book_id, min(page_id) AS page_id FROM pages GROUP BY 1)
SELECT h.book_id, h.href, row_number() OVER (PARTITION BY h.book_id ORDER BY min(h.pos), h.href) AS seq FROM h JOIN start USING (book_id, page_id) GROUP BY h.book_id, h.href""")
def discovered_links(spark, d):
    """Links over each host's chain of captured pages, from its first page; no capture here names a next one."""
    pages = captured.with_book(_pages(spark, d))
    seeds = pages.groupBy("book_id").agg(F.min_by("url", "page_id").alias("url"))
    return discover.discover(pages.select("page_id", "url", "html"), seeds)


# -- events ------------------------------------------------------------------------------------
@query("SELECT event_id, count(*) OVER w AS recent, count(*) OVER w <= 5 AS stable FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW)")
def stability_windows(spark, d):
    rows = stability(spark.read.parquet(f"{d}/events.parquet"), "user_id", 3600)
    return rows.select("event_id", "recent", "stable")


# -- streams, and what asks injected clients ---------------------------------------------------
def _arriving(spark: SparkSession, d: str, table: str) -> DataFrame:
    """A table's files as a stream; a pattern, as the path may name one file, which a stream takes for a folder otherwise."""
    return spark.readStream.schema(spark.read.parquet(f"{d}/{table}.parquet").schema).parquet(f"{d}/{table}.parque[t]")


@query(_DOCS + "SELECT book_id, seq, coalesce(n <= 100 AND length(plain) > 0 AND n > first, false) AS duplicate FROM r")
def stream_dedup_first100(spark, d):
    """dedup_first100's duplicates by the stream: documents as they lie in their folder, a second of event time for each id."""
    docs = _arriving(spark, d, "documents")
    plain = text.collapse(F.coalesce("text", F.lit("")))
    rows = docs.select(F.coalesce("source", F.lit("")).alias("book_id"), F.col("doc_id").alias("seq"), text.content_hash(plain).alias("content_hash"), (F.length(plain) > 0).alias("filled"), F.timestamp_seconds(F.col("doc_id") + 1).alias("ts"))
    return ordered.settled(ordered.capped_duplicates(rows, late="0 seconds"), "stream-dedup")


@query(ORACLES["stability_windows"])
def stream_stability(spark, d):
    """stability_windows by the stream."""
    return ordered.settled(ordered.trailing_counts(_arriving(spark, d, "events"), "user_id", 3600, late="0 seconds"), "stream-stability")


@query(ORACLES["discovered_links"])
def frontier_links(spark, d):
    """discovered_links by the crawl that follows captures as they arrive."""
    pages = _pages(spark, d)
    seeds = captured.with_book(pages).groupBy("book_id").agg(F.min_by("url", "page_id").alias("url"))
    folder = claimed(spark, "frontier")
    crawl = Frontier(spark, folder, seeds)
    crawl.start(_arriving(spark, d, "pages"), f"{folder}/checkpoint").awaitTermination()
    return crawl.links()


_SHEET = "body{margin:0} .toc{padding:1em} .chapter{color:#111} h1{font-size:2em} p{margin:0} blockquote{margin:1em} code{color:#222}"


def _designer(request: str) -> str | None:
    """A sheet for books of an even number of articles, an unsafe one for the others."""
    return f"```css\n{_SHEET}\n```" if int(request.split("The book: ")[1].split()[0]) % 2 == 0 else _SHEET + " @import 'x';"


@query(_BASE + _META + f"SELECT book_id, CASE WHEN article_count % 2 = 0 THEN '{_SHEET}' END AS css FROM m")
def book_layouts(spark, d):
    """Layouts of all books by a stub designer, asked once for each content."""
    return layout.layouts(filtering.kept(_classified(spark, d)), _designer).select("book_id", "css")


@query(_BASE + "SELECT book_id || '.html' AS name, sha256(encode(" + ORACLES["master_html"].split("SELECT book_id, ", 1)[1].split(" AS master_html", 1)[0] + ")) AS sha256 FROM k GROUP BY book_id")
def document_files(spark, d):
    """Every book's master document as a file of its own, written by the tasks with a commit, and read again."""
    folder = claimed(spark, "documents")
    sinks.write_documents(filtering.kept(_classified(spark, d)), folder)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))
