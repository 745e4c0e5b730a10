"""A crawl that goes on as captures arrive: chains of next pages and their links, kept in tables that each micro-batch extends.

The tables are folders of Parquet, one part for each batch, and a batch writes its parts anew from what the batches
before it wrote. So a batch that is run again after a failure writes the same, and one that is run twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.functions import urls
from quire.operators import discover
from quire.sources.staging import exists, owned, release, written

CAPTURES = "url string, page_id long, next_url string"
LINKS = "url string, pos int, href string"
REACHED = "book_id string, depth long, url string"


class Frontier:
    """Chains that start at seeds(book_id, url), at most max_pages pages each, over captures that arrive in any order.

    An address counts by the first capture that arrives, within a batch by the least page_id. What has been reached stays reached.
    """

    def __init__(self, spark: SparkSession, folder: str, seeds: DataFrame, max_pages: int = 5):
        self.spark, self.folder, self.max_pages = spark, folder.rstrip("/"), max_pages
        self.seeds = seeds.select("book_id", F.lit(1).cast("long").alias("depth"), "url").dropDuplicates(["book_id", "url"])
        self.first = seeds.groupBy("book_id").agg(F.min("url").alias("seed"))

    def _read(self, name: str, schema: str, before: int | None = None) -> DataFrame:
        """Rows of a table, or of the batches before one."""
        path = f"{self.folder}/{name}"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, batch long").parquet(path)
        return (rows if before is None else rows.where(F.col("batch") < before)).drop("batch")

    def _write(self, rows: DataFrame, name: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    def process(self, pages: DataFrame, batch: int) -> None:
        """One batch of captured pages(page_id, url, html): keeps what they link to, and moves the chains on as far as they go now."""
        owner = f"{self.folder} {batch}"
        with owned(owner):
            self._extend(pages, batch)
        release(self.spark, owner)

    def _extend(self, pages: DataFrame, batch: int) -> None:
        known = self._read("captures", CAPTURES, batch)
        ids = pages.where("url is not null").groupBy("url").agg(F.min("page_id").alias("page_id")).join(known.select("url"), "url", "left_anti")
        new = pages.join(ids, ["url", "page_id"]).select("page_id", "url", "html")
        found = written(discover.tree_links(new), "tree-links")
        nexts = found.select("url", "page_id", "next_url")
        self._write(nexts, "captures", batch)
        self._write(found.select("url", F.inline("anchors")).select("url", "pos", "href"), "links", batch)
        edges = known.unionByName(nexts).where("next_url is not null").select("url", "next_url")
        reached = self._read("reached", REACHED, batch)
        start = self.seeds.join(reached, ["book_id", "url"], "left_anti").select("book_id", "depth", "url")
        fresh, step = start, reached.unionByName(start)
        for _ in range(self.max_pages - 1):
            step = step.where(F.col("depth") < self.max_pages).join(edges, "url").select("book_id", (F.col("depth") + 1).alias("depth"), F.col("next_url").alias("url"))
            visited = reached.unionByName(fresh).select("book_id", "url")
            step = written(step.join(visited, ["book_id", "url"], "left_anti").groupBy("book_id", "url").agg(F.min("depth").alias("depth")).select("book_id", "depth", "url"), "step")
            if not step.take(1):
                break
            fresh = fresh.unionByName(step)
        self._write(fresh, "reached", batch)

    def start(self, pages: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Follows a stream of captured pages; the checkpoint lets it go on where it stopped."""
        return pages.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def chain(self) -> DataFrame:
        """(book_id, depth, url) reached so far."""
        return self._read("reached", REACHED)

    def links(self) -> DataFrame:
        """(book_id, seq, href): article links over the captured pages of each chain, first discovery first, as discover() gives them for all captures at once."""
        listed = self.chain().join(self._read("links", LINKS), "url").join(self.first, "book_id")
        listed = listed.where(urls.is_article_link(F.col("href"), F.col("seed")))
        return discover.first_seen(listed.select("book_id", F.col("depth").alias("page_id"), "pos", urls.without_fragment(F.col("href")).alias("href")))
