"""Extraction of readable articles; the tree lives inside one Arrow-batched call per page."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import content, html

EXTRACTED = "title string, content string, text_content string, length int, excerpt string, byline string, dir string, site_name string, lang string"


@dataclass(frozen=True)
class ExtractionOptions:
    strip_links: bool = True
    lazy_load: bool = True


def guarded(f: Callable, *columns: list) -> list:
    """f over rows; a row that fails is null, as a page that fails is dropped and the rest go on."""
    out = []
    for row in zip(*columns, strict=True):
        try:
            out.append(f(*row))
        except (ValueError, KeyError, IndexError, AttributeError, TypeError, RecursionError, OverflowError):
            out.append(None)
    return out


#: Pages of a batch that are Python strings, trees and results at the same time; the rest of it stays in Arrow.
SLICE_ROWS = 32


def sliced(f: Callable, kind: pa.DataType, *columns: pa.Array, failed=None) -> pa.Array:
    """f over rows as an Arrow array, a slice of rows at a time; `failed` stands for rows that fail or give none."""
    out = []
    for at in range(0, len(columns[0]), SLICE_ROWS):
        found = guarded(f, *(c.slice(at, SLICE_ROWS).to_pylist() for c in columns))
        out.append(pa.array([failed if x is None else x for x in found], kind))
    return pa.concat_arrays(out) if out else pa.array([], kind)


_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}


def by_page(f: Callable, kind: str, *columns: Column, failed=None, once: bool = False) -> Column:
    """f over rows of Python values as a column of a kind, a flat struct as "name kind, ..."; a struct's fields are all null where f fails or gives none.

    `once` keeps a filter on the result from having the page read once more; such a filter then reaches no scan.
    """
    struct = " " in kind
    of = pa.struct([(n, _KINDS[k]) for n, k in (x.split() for x in kind.split(", "))]) if struct else _KINDS[kind]

    def run(*got: pa.Array) -> pa.Array:
        return sliced(f, of, *got, failed={} if struct else failed)

    read = F.arrow_udf(run, kind)
    return (read.asNondeterministic() if once else read)(*columns)


def extracted(page: Column) -> Column:
    """Struct of the nine readable fields; all null if nothing readable is found."""
    return by_page(content.extract, EXTRACTED, page)


def article(page: Column, url: Column, options: ExtractionOptions = ExtractionOptions()) -> Column:
    """Struct of title and content_html; null fields if the page fails."""
    return by_page(lambda h, u: content.extract_article(h, u, not options.strip_links, options.lazy_load), "title string, content_html string", page, url, once=True)


def articles(fetched: DataFrame, options: ExtractionOptions = ExtractionOptions()) -> DataFrame:
    """(book_id, seq, url, title, content_html) of fetched(book_id, seq, url, html); failed pages drop out, order stays in seq."""
    got = fetched.withColumn("a", article(F.col("html"), F.col("url"), options))
    return got.where(F.col("a.content_html").isNotNull()).select("book_id", "seq", "url", F.coalesce("a.title", F.lit("")).alias("title"), "a.content_html")


def _tree(edit: Callable) -> Callable:
    def run(h: str | None, base: str | None):
        root = html.parse(h)
        n = edit(root, base)
        return {"html": html.inner_html(root), "n": n or 0}

    return run


_EDITS: dict[str, Callable] = {
    "prune": lambda root, base: html.prune(root),
    "strip_links": lambda root, base: html.strip_links(root),
    "reveal_images": lambda root, base: html.reveal_images(root),
    "style_code": lambda root, base: html.style_code(root),
    "replace_iframes": html.replace_iframes,
    "absolutise": html.absolutise,
}


def edited(edit: str, page: Column, base: Column | None = None) -> Column:
    """Struct (html, n): the page after one edit of the tree, and how many places it changed (for edits that count)."""
    return by_page(_tree(_EDITS[edit]), "html string, n long", page, F.lit(None).cast("string") if base is None else base)


def absolute(fragment: Column, base: Column) -> Column:
    """A fragment pruned again, with absolute addresses and thinned white space."""
    return by_page(html.absolute_html, "string", fragment, base)


def plain(fragment: Column) -> Column:
    """Collapsed text of any fragment; empty if it can't be read."""
    return by_page(html.plain_text, "string", fragment, failed="")


def link_share(fragment: Column, text: Column) -> Column:
    """Characters inside anchors over those of the text, read from the tree."""

    def one(h, t):
        return sum(len(a.text()) for a in html.body(html.parse(h)).find("a")) / max(1, len(t))

    return by_page(one, "double", fragment, text, failed=0.0)


def load_more_target(page: Column) -> Column:
    """Label of the control a live page would be asked to load more with; null if there is none."""
    return by_page(lambda x: html.load_more_target(html.parse(x)), "string", page)
