import re

import pytest
from pyspark.sql import functions as F

from quire.operators import discover, filtering
from quire.sources import pages as captured

PAGES = "page_id long, url string, html string"

ANCHORS = [
    ("<a href=/plain>p</a>", ["https://h.com/plain"]),
    ('<a href="/it\'s">q</a>', ["https://h.com/it's"]),
    ("<a href='/say-\"x\"'>q</a>", ["https://h.com/say-%22x%22"]),
    ('<a href="/a?x=1&amp;y=2">e</a>', ["https://h.com/a?x=1&y=2"]),
    ('<a href="/caf&eacute;">e</a>', ["https://h.com/caf%C3%A9"]),
    ('<A\n  class="k"\n  HREF = "/upper" >u</A>', ["https://h.com/upper"]),
    ('<a title="a > b" href="/gt">g</a>', ["https://h.com/gt"]),
    ('<a href="/one">1</a><a href="  ">blank</a><a>none</a><a href="/two">2</a>', ["https://h.com/one", "https://h.com/two"]),
    ('<!-- <a href="/no">n</a> --><script>var x = "<a href=/no>n</a>"</script><a href="/yes">y</a>', ["https://h.com/yes"]),
    ('<a href="http://[">bad</a><a href="mailto:x@y">m</a>', ["mailto:x@y"]),
    ('<a href="../up/./x">r</a><a href="//o.com/">o</a><a href="#f">f</a>', ["https://h.com/up/x", "https://o.com/", "https://h.com/d/p#f"]),
    ('<div><a href="/open">never closed', ["https://h.com/open"]),
    ("", []),
    (None, []),
]


def test_anchors_of_any_markup(spark):
    rows = [(i, "https://h.com/d/p", h) for i, (h, _) in enumerate(ANCHORS)]
    got = {r["page_id"]: r["anchors"] for r in discover.tree_links(spark.createDataFrame(rows, PAGES)).collect()}
    for i, (h, want) in enumerate(ANCHORS):
        assert [a["href"] for a in got[i]] == want, h
    assert [a["label"] for a in got[7]] == ["1", "2"] and [a["pos"] for a in got[7]] == [0, 1]


def test_next_page_and_anchors_come_from_one_parse(spark):
    rows = [(1, "https://h.com/1", '<a class=next href=/2>Next</a><a href=/post/x>x</a>'), (2, "https://h.com/2", "<a href=/post/y>y</a>")]
    got = {r["page_id"]: r for r in discover.tree_links(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[1]["next_url"] == "https://h.com/2" and got[2]["next_url"] is None and len(got[1]["anchors"]) == 2
    seeds = spark.createDataFrame([("h.com", "https://h.com/1")], "book_id string, url string")
    links = discover.discover(spark.createDataFrame(rows, PAGES), seeds)
    assert [r["href"] for r in links.orderBy("seq").collect()] == ["https://h.com/2", "https://h.com/post/x", "https://h.com/post/y"]


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture
def shelf(spark, tmp_path):
    rows = [(i, f"https://h{i % 3}.com/{i % 8}", f"<title>t{i}</title><article><p>{'word ' * 40}{i % 4}</p></article><a href='/p/{i}'>x</a>") for i in range(24)]
    spark.createDataFrame(rows, PAGES).write.parquet(str(tmp_path / "pages"))
    return captured.read_pages(spark, str(tmp_path / "pages"))


def test_links_are_grouped_by_hash_and_no_page_is_grouped_at_all(spark, shelf):
    links = discover.first_seen(discover.article_links(shelf))
    assert "SortAggregate" not in plan(links) and "HashAggregate" in plan(links)
    fetched = captured.fetch(shelf, links)
    assert "SortAggregate" not in plan(fetched)
    listed = discover.first_seen(captured.with_book(shelf).select("book_id", "page_id", F.lit(0).alias("pos"), F.col("url").alias("href")))
    got = captured.fetch(shelf, listed).collect()
    assert len(got) == 24 and all(re.search(r"<title>t(\d+)", r["html"]) for r in got)


def test_flat_articles_are_classified_without_being_written(spark, shelf):
    from quire.sources import staging

    flat = captured.flat_articles(shelf)
    before = len(staging._written)
    quick = filtering.classify(flat, flat=True)
    assert len(staging._written) == before
    slow = filtering.classify(flat.unionByName(flat.limit(1)), flat=True)  # a repeated row needs a number
    assert len(staging._written) == before + 1
    assert slow.count() == 25 and {(r["seq"], r["reason"]) for r in quick.collect()} <= {(r["seq"], r["reason"]) for r in slow.collect()}
    assert quick.columns == slow.columns
    same = filtering.classify(flat.select("book_id", "seq", "url", "title", "content_html"))
    assert sorted((r["seq"], r["reason"] or "") for r in same.collect()) == sorted((r["seq"], r["reason"] or "") for r in quick.collect())
    narrow = quick.select("book_id", "seq", "reason")
    assert narrow.where("reason is not null").count() == 24 - len({(i % 3, i % 4) for i in range(24)})


def test_ties_in_a_book_are_broken_alike_however_rows_are_dealt(spark):
    rows = [("b", 1, f"https://h/{i % 5}", f"t{i}", f"<p>{'same words ' * 20}{i % 3}</p>") for i in range(12)]
    df = spark.createDataFrame(rows, "book_id string, seq long, url string, title string, content_html string")
    some = lambda d: sorted((r["title"], r["reason"] or "") for r in filtering.classify(d).collect())
    cut = lambda d: sorted((r["title"], r["batch"], r["pos"]) for r in filtering.batches(d, 5).collect())
    assert some(df) == some(df.orderBy(F.desc("title")).repartition(3)) and cut(df) == cut(df.orderBy(F.desc("title")).repartition(3))


def test_unnesting_links_parses_a_page_once(spark):
    pages = spark.createDataFrame([(1, "https://a.com/", '<a href="/x">x</a><a href="/y">y</a>')], "page_id long, url string, html string")
    found = discover.tree_links(pages).select("page_id", F.inline("anchors")).where("href is not null")
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(r["href"] for r in found.collect()) == ["https://a.com/x", "https://a.com/y"]
