"""From captured pages to books: discover, limit, extract, filter, assemble; one lazy plan for all books."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from quire.operators import assemble, discover, extract, filtering
from quire.sources import pages as captured


@dataclass(frozen=True)
class BookOptions:
    max_articles: int = 10
    max_pages: int = 5
    extraction: extract.ExtractionOptions = field(default_factory=extract.ExtractionOptions)
    filter: filtering.FilterOptions | None = field(default_factory=filtering.FilterOptions)
    judge: Callable[[str], str | None] | None = None


def extracted_articles(pages: DataFrame, seeds: DataFrame, options: BookOptions = BookOptions()) -> DataFrame:
    """Articles of the books that seeds(book_id, url) start: (book_id, seq, url, title, content_html)."""
    links = discover.limit_per_book(discover.discover(pages, seeds, options.max_pages), options.max_articles)
    return extract.articles(captured.fetch(pages, links), options.extraction)


def classified_articles(pages: DataFrame, seeds: DataFrame, options: BookOptions = BookOptions()) -> DataFrame:
    """The same with reason: by the judge if there is one, else by the rules; all kept if filtering is off."""
    articles = extracted_articles(pages, seeds, options)
    if options.filter is None:
        return filtering.classify(articles, filtering.FilterOptions(0, False, False, 0))
    if options.judge is not None:
        return filtering.judged(articles, options.judge, options=options.filter)
    return filtering.classify(articles, options.filter)


def books(pages: DataFrame, seeds: DataFrame, options: BookOptions = BookOptions(), css: str | None = None) -> DataFrame:
    return assemble.books(filtering.kept(classified_articles(pages, seeds, options)), css)
