"""Bounded samples of labelled training rows for the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import discard, in_training_fold, staged


def fraction(*columns) -> F.Column:
    """A place from 0 to 1 by the hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def labelled(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, y, place) of about per_class training rows of each class (all, if there are no more), and the number of training labels of each class.

    text is a whole text's bytes. Ids are chosen by their hash (place, from 0 to 1) against the share that per_class is of the class, so no task ranks
    them. Rows held out by the fold, null labels and null texts teach nothing. An id with several labels takes the least, one with
    several texts the least of them. The ids chosen are about 2 * per_class, and are broadcast.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & in_training_fold(mod, held)).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    place = fraction(F.col("doc_id").cast("string"), F.lit(label))
    share = F.when(F.col("y") == 1, per_class / counts.get(1, 1)).otherwise(per_class / counts.get(0, 1))
    ids = rows.withColumn("place", place).where(F.col("place") < share).select("doc_id", "y", (F.col("place") / share).alias("place"))
    got = docs.where("text is not null").select("doc_id", F.col("text").cast("string").cast("binary").alias("text")).join(F.broadcast(ids), "doc_id")
    return got.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"), F.min("place").alias("place")), counts


def within(rows: DataFrame, data: str, most: int) -> list:
    """Rows of a sample, by place, for as long as their data columns hold at most so many bytes together; one that does not fit alone is left out.

    This bounds the learner's memory by whole rows. The driver sees the sizes of the sample's rows first, then those that fit.
    """
    rows = staged(rows, "sample")
    sizes = sorted((r["place"], r["doc_id"], r["n"]) for r in rows.select("place", "doc_id", F.octet_length(data).alias("n")).collect())
    held, ids = 0, []
    for _, i, n in sizes:
        if held + n <= most:
            held += n
            ids.append(i)
    got = rows.collect() if len(ids) == len(sizes) else rows.where(F.col("doc_id").isin(ids)).collect()
    discard(rows)
    return got


def best_cut(margins: np.ndarray, y: np.ndarray, counts: dict[int, int]) -> float:
    """The margin that parts the sample's classes with the least error when each class weighs what it counts in all labels; the middle of the best gap."""
    order = np.argsort(margins, kind="stable")
    m, y = margins[order], y[order]
    weight = np.where(y == 1, counts[1] / max(1, (y == 1).sum()), counts[0] / max(1, (y == 0).sum()))
    below = np.r_[0.0, np.cumsum(np.where(y == 1, weight, 0))] + np.r_[np.cumsum(np.where(y == 0, weight, 0)[::-1])[::-1], 0.0]
    edges = np.r_[m[0] - 1, (m[1:] + m[:-1]) / 2, m[-1] + 1]
    usable = np.r_[True, m[1:] > m[:-1], True]
    least = below[usable].min()
    good = edges[usable & (below <= least + 1e-9 * (1 + least))]
    return float((good[0] + good[-1]) / 2)
