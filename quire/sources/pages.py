"""Captured pages: the engine starts where a browser would have stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text, urls
from quire.sources.staging import small_batches


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, html) of a Parquet table of captured pages, which cross to Python in small batches."""
    small_batches(spark)
    return spark.read.parquet(path).select("page_id", "url", "html")


def lookup(pages: DataFrame, url: str) -> DataFrame:
    """Captured HTML of one address; the filter reaches the scan."""
    return pages.where(F.col("url") == url).select("html")


def with_book(pages: DataFrame) -> DataFrame:
    """Adds book_id, the host of the address, and seq, the order within the book."""
    return pages.withColumn("book_id", urls.host_of(F.col("url"))).withColumn("seq", F.col("page_id"))


def fetch(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Captured pages of links(book_id, seq, href), in their order, the first capture of each; links without one drop out.

    The capture of each address is chosen by its id alone, before any HTML is read: page_id names a capture.
    """
    first = pages.groupBy("url").agg(F.min("page_id").alias("page_id"))
    chosen = links.select("book_id", "seq", F.col("href").alias("url")).join(first, "url")
    return chosen.join(pages.select("page_id", "url", "html"), ["url", "page_id"]).select("book_id", "seq", "url", "html")


def allowed_requests(requests: DataFrame) -> DataFrame:
    """requests(url, resource_type) that are not blocked."""
    return requests.where(~text.is_blocked(F.col("url"), F.col("resource_type")))


def flat_articles(pages: DataFrame) -> DataFrame:
    """book_id, seq, url, title, content_html, plain from the pages' own article element, all in native expressions.

    For captures with one flat `<article>`; extract.articles() reads any page.
    """
    title = text.unescape(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1))
    content = F.regexp_extract("html", r"(?s)<article>(.*?)</article>", 1)
    return with_book(pages).select("book_id", "seq", "url", title.alias("title"), content.alias("content_html"), text.flat_text(content).alias("plain"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files, in any store Spark reads."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def verified(sums: DataFrame, expected: DataFrame) -> DataFrame:
    """checksums() with ok: whether expected(path, digest) names the same digest, read up to the first blank in any case; false if none is given."""
    wanted = expected.select(F.col("path").alias("_path"), F.lower(F.regexp_extract(F.trim("digest"), r"^\S+", 0)).alias("_digest"))
    return sums.join(wanted, F.col("path") == F.col("_path"), "left").withColumn("ok", F.coalesce((F.col("_digest") != "") & (F.col("sha256") == F.col("_digest")), F.lit(False))).drop("_path", "_digest")
