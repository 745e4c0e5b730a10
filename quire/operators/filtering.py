"""Which articles make the book: capped duplicates, rules, and decisions by an injected judge."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import extract
from quire.operators.calls import AT_ONCE, DEADLINE, answers
from quire.sources.staging import written

DEDUP_CAP = 100
BATCH = 10
OMITTED_BY_FILTER = "Omitted by filter"


@dataclass(frozen=True)
class FilterOptions:
    min_length: int = 100
    pattern_check: bool = True
    ratio_check: bool = True
    dedup_cap: int = DEDUP_CAP


def with_plain(articles: DataFrame) -> DataFrame:
    """Adds plain, the text of any HTML; flat captures have it already."""
    return articles if "plain" in articles.columns else articles.withColumn("plain", extract.plain(F.col("content_html")))


def _order(rows: DataFrame) -> list:
    """The order of articles in a book: by seq, and alike on every run where several have the same."""
    return ["seq", *(c for c in ("url", "title") if c in rows.columns), *(F.xxhash64(c) for c in ("content_html", "plain") if c in rows.columns)]


def classify(articles: DataFrame, options: FilterOptions = FilterOptions(), flat: bool = False) -> DataFrame:
    """articles(book_id, seq, url, title, content_html) with plain, content_hash, reason (null: kept).

    The first articles of a book are compared with those before them, omitted ones included; a duplicate
    is named as such before any rule. Of articles at one place of a book one is first, on every run the same, so none is lost.
    Only hashes are ranked, and no more than the cap of a book leave a task, so a book of any size never gathers; rules are one CASE.
    Articles are written once with a number each, by which the few duplicates are joined back, so that extraction runs once. flat: fragments without
    nesting, whose link shares and text are native expressions; if each has a place of its own, that is what it is joined by, and no content is written.
    """
    rows = with_plain(articles)
    rows = rows.withColumn("content_hash", text.content_hash(F.col("plain"))).withColumn("title", text.titled(F.col("title")))
    share = None
    if options.ratio_check and not flat:
        share = F.col("_share")
        rows = rows.withColumn("_share", extract.link_share(F.col("content_html"), F.col("plain")))
    rule = text.rule_reason(F.col("title"), F.col("plain"), F.col("content_html"), options.min_length, options.pattern_check, options.ratio_check, share)
    rows = rows.withColumn("_rule", rule).drop("_share")
    own = ["book_id", "seq"]
    if not flat or articles.groupBy(*own).agg(F.count("*").alias("n")).where("n > 1 or book_id is null or seq is null").limit(1).count():
        own = ["_row"]
        rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "classified")
    again = duplicates(rows, own, options.dedup_cap).withColumn("_again", F.lit(True))
    rows = rows.join(again, own, "left")
    rows = rows.withColumn("reason", F.when(F.col("_again"), F.lit(text.DUPLICATE)).otherwise(F.col("_rule"))).drop("_row", "_again", "_rule")
    return rows.select(*[c for c in articles.columns if c in rows.columns], *[c for c in rows.columns if c not in articles.columns])


def duplicates(rows: DataFrame, own: list[str], cap: int = DEDUP_CAP) -> DataFrame:
    """What names them (own) of articles among the first `cap` of a book whose text an earlier one of them has; empty texts are never compared."""
    tie = F.xxhash64(*(c for c in ("url", "title", "content_hash") if c in rows.columns)).alias("_tie")
    narrow = rows.select(*dict.fromkeys(["book_id", "seq", *own]), tie, "content_hash", (F.length("plain") > 0).alias("filled"))
    place = F.row_number().over(Window.partitionBy("book_id").orderBy("seq", "_tie", *own))
    head = narrow.withColumn("n", place).where(F.col("n") <= cap)
    first = F.min("n").over(Window.partitionBy("book_id", "content_hash"))
    return head.where("filled").withColumn("first", first).where("n > first").select(*own)


def kept(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("reason").isNull())


def omitted(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("reason").isNotNull()).select("book_id", "seq", "url", "title", "reason")


def omission_counts(classified: DataFrame) -> DataFrame:
    """(book_id, reason, pages)."""
    return omitted(classified).groupBy("book_id", "reason").agg(F.count("*").alias("pages"))


def run_counts(classified: DataFrame) -> DataFrame:
    """(book_id, extracted, omitted, kept)."""
    gone = F.count_if(F.col("reason").isNotNull())
    return classified.groupBy("book_id").agg(F.count("*").alias("extracted"), gone.alias("omitted"), (F.count("*") - gone).alias("kept"))


def counted(classified: DataFrame) -> tuple[DataFrame, Observation]:
    """The same rows, and an observation that holds extracted and omitted once an action has gone over all of them: the run's counts without a scan of their own."""
    seen = Observation()
    return classified.observe(seen, F.count(F.lit(1)).alias("extracted"), F.count_if(F.col("reason").isNotNull()).alias("omitted")), seen


def batches(articles: DataFrame, size: int = BATCH) -> DataFrame:
    """Adds batch and pos, both from 0: runs of `size` articles in order within a book."""
    n = F.row_number().over(Window.partitionBy("book_id").orderBy(*_order(articles))) - 1
    return articles.withColumn("_n", n).withColumn("batch", F.floor(F.col("_n") / size).cast("long")).withColumn("pos", (F.col("_n") % size).cast("long")).drop("_n")


def prompt_lines(articles: DataFrame, size: int = BATCH) -> DataFrame:
    """(book_id, batch, pos, line): number, title, address, length and the first 200 characters, as a judge reads them."""
    return _lines(batches(with_plain(articles), size))


def _lines(rows: DataFrame) -> DataFrame:
    line = F.format_string('%d. Title: "%s" | URL: %s | Length: %d chars | Snippet: "%s"', F.col("pos") + 1, text.collapse(text.titled(F.col("title"))), F.col("url"), F.length("plain"), F.substring("plain", 1, 200))
    return rows.select("book_id", "batch", "pos", line.alias("line"))


def build_prompt(lines: list[str]) -> str:
    """Asks for one decision per article, as a bare JSON array."""
    return (
        "Some of these pages were collected for an ebook. Say for each, in order, whether it is a piece worth reading (include) or not:"
        " error pages, login walls, stubs, lists of links, repeats of another page here and imprint or contact pages are not.\n\n"
        + "\n".join(lines)
        + f'\n\nAnswer with a JSON array of {len(lines)} objects {{"include": true or false, "reason": "why not, if left out"}} and nothing else.'
    )


def parse_decisions(raw: str | None, expected: int) -> list[dict] | None:
    """Decisions of a reply; None unless it is an array of exactly `expected` objects with a boolean include."""
    body = re.sub(r"(?i)\s*```$", "", re.sub(r"(?i)^```(?:json)?\s*", "", (raw or "").strip())).strip()
    try:
        got = json.loads(body, parse_constant=lambda _: 1 / 0)
    except (ValueError, ZeroDivisionError, RecursionError):
        return None
    if not isinstance(got, list) or len(got) != expected or not all(isinstance(d, dict) and isinstance(d.get("include"), bool) for d in got):
        return None
    given = [d["reason"] if isinstance(d.get("reason"), str) else "" for d in got]
    return [{"include": d["include"], "reason": reason if reason or d["include"] else OMITTED_BY_FILTER} for d, reason in zip(got, given)]


DECISIONS = "array<struct<include:boolean,reason:string>>"


def decisions(replies: DataFrame) -> DataFrame:
    """replies(…, raw, expected) with decisions, null for an invalid reply."""

    def run(raw: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([parse_decisions(r, int(k)) for r, k in zip(raw, n, strict=True)], dtype=object)

    return replies.withColumn("decisions", F.pandas_udf(run, DECISIONS)("raw", "expected"))


def judged(articles: DataFrame, judge: Callable[[str], str | None], size: int = BATCH, options: FilterOptions = FilterOptions(), seconds: float = DEADLINE, at_once: int = AT_ONCE) -> DataFrame:
    """classify() by a judge: it gets a prompt per batch and returns a reply.

    A batch whose judge fails, takes longer than `seconds` or gives an invalid reply goes by the rules, for itself alone; a valid reply replaces the rules.
    The judge is called in tasks, `at_once` batches at a time, and once for each: articles and replies are written before they are used,
    so nothing that follows asks again (a task that is lost does). Every article comes back once, whatever the judge says.
    """
    rows = written(batches(with_plain(articles), size).withColumn("title", text.titled(F.col("title"))), "batches")
    asked = _lines(rows).groupBy("book_id", "batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("lines"))

    def ask(some: pd.Series) -> pd.Series:
        return pd.Series(answers(judge, [build_prompt(list(x)) for x in some], seconds, at_once), dtype=object)

    answered = F.pandas_udf(ask, "string").asNondeterministic()("lines")
    replies = written(asked.select("book_id", "batch", answered.alias("raw"), F.size("lines").alias("expected")), "replies")
    verdicts = decisions(replies).select("book_id", "batch", F.posexplode_outer("decisions").alias("pos", "decision"))
    names = rows.columns
    valid = verdicts.where("decision is not null").select("book_id", "batch", F.col("pos").cast("long").alias("pos"), "decision")
    decided = rows.join(valid, ["book_id", "batch", "pos"]).withColumn("reason", F.when(~F.col("decision.include"), F.col("decision.reason"))).select(*names, "reason")
    failed = rows.join(verdicts.where("decision is null").select("book_id", "batch"), ["book_id", "batch"], "left_semi")
    apart = failed.withColumn("_whole", F.col("book_id")).withColumn("book_id", F.concat_ws(" ", "book_id", "batch"))
    ruled = classify(apart, options).withColumn("book_id", F.col("_whole")).select(*names, "reason")
    return decided.unionByName(ruled)
