"""Style sheets for all books by an injected designer, kept under the content's key in a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators.calls import AT_ONCE, DEADLINE, answers
from quire.operators.metadata import cache_key, content_metadata
from quire.sources.staging import exists, written

PROVIDERS = ("gemini", "openai", "anthropic")
SHEETS = "key string, css string, made timestamp"


def kept_sheets(spark: SparkSession, cache: str | None) -> DataFrame:
    """(key, css) of a cache, a Parquet table of SHEETS that runs append to; of several sheets of a key the latest. Empty without a cache."""
    if not cache or not exists(spark, cache):
        return spark.createDataFrame([], SHEETS).select("key", "css")
    return spark.read.schema(SHEETS).parquet(cache).groupBy("key").agg(F.max_by("css", "made").alias("css"))


def design_request(m: dict) -> str:
    """Asks for a print style sheet that suits the content."""
    return (
        "Write a style sheet for a book printed on A4 from HTML. The body holds div.toc (h1, ul.toc-list, li.toc-item, a, span.toc-item-number) and one div.chapter per article (h1, then article HTML).\n"
        f"The book: {m['article_count']} articles of about {m['avg_article_length']} characters, {m['code_block_count']} code blocks, {m['image_count']} images, {m['table_count']} tables, "
        f"{m['list_count']} lists, {m['blockquote_count']} quotes, headings to h{m['heading_depth']}, long articles: {'yes' if m['has_long_articles'] else 'no'}.\n"
        "Style body, .toc and .chapter with page breaks, compact spacing and print rules; no imports, no local or data addresses. Answer with the CSS alone."
    )


def layouts(
    articles: DataFrame, designer: Callable[[str], str | None], cache: str | None = None, provider: str = "gemini", model: str | None = None, fresh: bool = False, seconds: float = DEADLINE, at_once: int = AT_ONCE
) -> DataFrame:
    """(book_id, key, css) of all books of articles: the kept sheet of a book's key, else what the designer makes of its profile; null if that fails or is unsafe.

    Books of the same key ask once. The designer is called in tasks, `at_once` at a time, each with a deadline. Answers are written before they
    are used, and good ones are appended to the cache, so a second run asks only for what failed. fresh: kept sheets are not read, but replaced.
    """
    spark, named = articles.sparkSession, F.lit(provider)
    key = cache_key(named, F.lit(model) if model else text.default_model(named)).alias("key")
    profiles = written(content_metadata(articles).select("*", key), "profiles")
    known = kept_sheets(spark, None if fresh else cache)
    missing = profiles.join(known, "key", "left_anti").dropDuplicates(["key"])

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            raw = answers(designer, [design_request(m) for m in rows.to_dict("records")], seconds, at_once)
            yield pd.DataFrame({"key": rows["key"], "raw": pd.Series(raw, index=rows.index, dtype=object)})

    asked = written(missing.mapInPandas(ask, "key string, raw string"), "sheets")
    made = asked.select("key", text.strip_fences(F.col("raw")).alias("css")).where(text.css_is_valid(F.col("css")))
    if cache:
        made.withColumn("made", F.current_timestamp()).write.mode("append").parquet(cache)
    return profiles.select("book_id", "key").join(known.unionByName(made), "key", "left").select("book_id", "key", "css")


def layout(articles: DataFrame, designer: Callable[[str], str | None], provider: str = "gemini", model: str | None = None, cache: str | None = None, fresh: bool = False) -> str | None:
    """One book's style sheet; None if there is no valid one."""
    rows = layouts(articles, designer, cache, provider, model, fresh).take(1)
    return rows[0]["css"] if rows else None
