"""Link discovery over captured pages: anchors, article links in order of discovery, and chains of next pages."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import html, urls
from quire.functions.urls import resolve
from quire.operators import extract
from quire.sources.staging import written


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, url, pos, href): every non-blank href of an anchor, by place on the page, in native expressions."""
    hrefs = F.regexp_extract_all("html", F.lit(r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["']([^"'>]*)["']"""), F.lit(1))
    found = pages.select("page_id", "url", F.posexplode(hrefs).alias("pos", "href"))
    return found.where(F.trim("href") != "")


def article_links(pages: DataFrame) -> DataFrame:
    """(book_id, page_id, pos, href): anchors resolved as a browser does, kept if they look like articles, without fragments."""
    found = anchors(pages).withColumn("full", urls.resolved(F.col("href"), F.col("url")))
    found = found.where(urls.is_article_link(F.col("full"), F.col("url")))
    return found.select(urls.host_of(F.col("url")).alias("book_id"), "page_id", "pos", urls.without_fragment(F.col("full")).alias("href"))


def first_seen(links: DataFrame) -> DataFrame:
    """Distinct links of each book in order of discovery: (book_id, seq, href).

    Grouping takes the least place of each link with map-side minima, hashed, as page and position make one number; only distinct links are numbered.
    """
    place = F.col("page_id").cast("decimal(19,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("pos").cast("decimal(10,0)")
    once = links.groupBy("book_id", "href").agg(F.min(place).alias("place"))
    number = F.row_number().over(Window.partitionBy("book_id").orderBy("place", "href"))
    return once.select("book_id", number.cast("long").alias("seq"), "href")


def limit_per_book(links: DataFrame, most: int = 10) -> DataFrame:
    """The first links of each book; the limit comes before extraction, so a book may end up with fewer articles."""
    return links.where(F.col("seq") <= most)


TREE_LINKS = "next_url string, anchors array<struct<pos:int,href:string,label:string>>"
_TREE_LINKS = pa.struct([("next_url", pa.string()), ("anchors", pa.list_(pa.struct([("pos", pa.int32()), ("href", pa.string()), ("label", pa.string())])))])


def tree_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, next_url, anchors): what the tree of each page says, read in one go: the next page, and every anchor's place, address made absolute, and label.

    Any markup is read as a browser does: unquoted addresses, entities, apostrophes, line breaks in tags; commented ones and those in scripts are none.
    An address that can't be resolved or is blank leaves its place out. A page that can't be read has no links.
    """

    def one(page: str | None, url: str | None):
        root = html.parse(page)
        hrefs = [(e, e.attrs["href"]) for e in root.find("a") if e.attrs.get("href", "").strip()]
        full = [(i, resolve(h, url), html.collapse(e.text())) for i, (e, h) in enumerate(hrefs)]
        return {"next_url": html.next_page(root, url), "anchors": [{"pos": i, "href": h, "label": t} for i, h, t in full if h]}

    def run(page: pa.Array, url: pa.Array) -> pa.Array:
        return extract.sliced(one, _TREE_LINKS, page, url, failed={"next_url": None, "anchors": []})

    read = F.arrow_udf(run, TREE_LINKS).asNondeterministic()  # else what filters or unnests the links has the page parsed once more
    return pages.select("page_id", "url", read("html", "url").alias("t")).select("page_id", "url", "t.*")


def next_links(pages: DataFrame) -> DataFrame:
    """(url, next_url) of pages that name a next page; an address captured several times counts by its first capture that does."""
    return _first_next(tree_links(pages))


def _first_next(found: DataFrame) -> DataFrame:
    return found.where(F.col("next_url").isNotNull()).groupBy("url").agg(F.min_by("next_url", "page_id").alias("next_url"))


def pagination_chain(seeds: DataFrame, nexts: DataFrame, max_pages: int = 5) -> DataFrame:
    """(book_id, depth, url): from each seed along next links, never to an address seen before, at most max_pages pages.

    A frontier: each step is written, so plans don't grow with the depth, and the loop ends when no chain goes on.
    Repeated seeds count once, and of several next links of an address the least does.
    """
    nexts = written(nexts.groupBy("url").agg(F.min("next_url").alias("next_url")), "nexts")
    step = seeds.select("book_id", F.lit(1).cast("long").alias("depth"), "url", F.array("url").alias("seen")).dropDuplicates(["book_id", "url"])
    out = step
    for _ in range(max_pages - 1):
        step = step.join(nexts, "url").where(~F.array_contains("seen", F.col("next_url")))
        step = written(step.select("book_id", (F.col("depth") + 1).alias("depth"), F.col("next_url").alias("url"), F.concat("seen", F.array("next_url")).alias("seen")), "frontier")
        if not step.take(1):
            break
        out = out.unionByName(step)
    return out.select("book_id", "depth", "url")


def discover(pages: DataFrame, seeds: DataFrame, max_pages: int = 5) -> DataFrame:
    """Article links of each book over its chain of pages, first discovery first: (book_id, seq, href).

    seeds(book_id, url). Links are judged by the seed's host. A page that was not captured ends its chain. Each page is parsed once;
    what is written, grouped and shuffled from there on are its links, not its HTML.
    """
    found = written(tree_links(pages).select("page_id", "url", "next_url", F.transform("anchors", lambda a: F.struct(a["pos"], a["href"])).alias("anchors")), "tree-links")
    chain = pagination_chain(seeds, _first_next(found), max_pages)
    base = seeds.groupBy("book_id").agg(F.min("url").alias("seed"))
    once = found.groupBy("url").agg(F.min("page_id").alias("page_id"))  # one capture of an address
    listed = chain.join(once, "url").join(found.select("url", "page_id", "anchors"), ["url", "page_id"]).join(base, "book_id")
    links = listed.select("book_id", "depth", "seed", F.inline("anchors"))
    links = links.where(urls.is_article_link(F.col("href"), F.col("seed")))
    return first_seen(links.select("book_id", F.col("depth").alias("page_id"), "pos", urls.without_fragment(F.col("href")).alias("href")))


def union_links(*parts: DataFrame) -> DataFrame:
    """Links of several snapshots, parts in order: each link once, at its first place."""
    out = None
    for i, part in enumerate(parts):
        part = part.select("book_id", F.lit(i).cast("long").alias("page_id"), F.col("seq").alias("pos"), "href")
        out = part if out is None else out.unionByName(part)
    return first_seen(out)
