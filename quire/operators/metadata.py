"""A profile of each book's content, one aggregation by book, and the key under which layouts are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _tags(names: str) -> Column:
    return F.sum(F.regexp_count("content_html", F.lit(rf"(?i)<({names})(?![A-Za-z0-9_])"))).cast("long")


def content_metadata(articles: DataFrame) -> DataFrame:
    """One row per book: counts of articles, characters and elements, deepest heading, long articles, titles in order."""
    size = F.length("content_html")
    levels = F.transform(F.regexp_extract_all("content_html", F.lit(r"(?i)<h([1-6])(?![A-Za-z0-9_])"), F.lit(1)), lambda x: x.cast("long"))
    return articles.groupBy("book_id").agg(
        F.count("*").alias("article_count"),
        F.sum(size).cast("long").alias("total_characters"),
        F.floor(F.avg(size) + 0.5).cast("long").alias("avg_article_length"),
        _tags("pre|code").alias("code_block_count"),
        _tags("img").alias("image_count"),
        _tags("table").alias("table_count"),
        F.greatest(F.lit(1).cast("long"), F.max(F.array_max(levels))).alias("heading_depth"),
        _tags("ul|ol").alias("list_count"),
        _tags("blockquote").alias("blockquote_count"),
        F.bool_or(size > 10000).alias("has_long_articles"),
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "title"))), lambda x: x["title"]).alias("article_titles"),
    )


# Names in the key's JSON, in order.
_NAMES = {
    "articleCount": "article_count", "totalCharacters": "total_characters", "avgArticleLength": "avg_article_length", "codeBlockCount": "code_block_count", "imageCount": "image_count", "tableCount": "table_count",
    "headingDepth": "heading_depth", "listCount": "list_count", "blockquoteCount": "blockquote_count", "hasLongArticles": "has_long_articles", "articleTitles": "article_titles",
}


def cache_key(provider: Column, model: Column) -> Column:
    """Over the columns of content_metadata(): the first 16 hex digits of the SHA-256 of metadata, provider and model as JSON."""
    meta = F.struct(*(F.col(c).alias(n) for n, c in _NAMES.items()))
    return F.substring(F.sha2(F.to_json(F.struct(meta.alias("metadata"), provider.alias("provider"), model.alias("model"))), 256), 1, 16)
