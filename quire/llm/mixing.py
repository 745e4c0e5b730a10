"""Mixing sources to target weights by pivotal dependent rounding.

Every document gets the fractional number of copies that takes its source to its target. In a bucket the
largest open document is paired with all smaller open ones together: mass, measured in words, moves between the two
sides in a random direction until one document holds a whole number, and so on until one is open. So each document keeps
its chance and the sum stays, and large documents are settled while smaller ones can still take up the difference: what is left of a bucket
is the smallest, unless one document outweighs all others. The buckets' leftovers meet in a reduction tree that works the same way, and a
source's words differ from its target by a part of the last leftover.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import WORD, columns_apart, discard, staged

WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3
BUCKET_ROWS = 4096
FAN_IN = 1024
SEED = 20


def pivot(sizes: list[float], probs: list[float], rng: np.random.Generator) -> tuple[list[int], int, float]:
    """Rounds probs to 0 or 1, each at its own chance, so that the sum of size * prob stays; sizes descend.

    Returns the bits, and the index and probability of what is left over (-1: nothing).
    """
    bits = [int(q >= 1) for q in probs]
    which = np.array([i for i, (s, q) in enumerate(zip(sizes, probs, strict=True)) if s > 0 and 1e-12 < q < 1 - 1e-12], np.int64)
    for i, q in enumerate(probs):
        if 1 - 1e-12 <= q < 1:
            bits[i] = 1
    size, chance = np.array(sizes)[which], np.array(probs)[which]
    draws = rng.random(len(which))
    step = 0
    while len(which) > 1:
        s, q, others = size[0], chance[0], chance[1:]
        way = others * (1 - others)  # the smaller ones move along one direction, to and fro
        width = float(size[1:] @ way)
        # words that may reach the largest or leave it before somebody holds a whole number
        up = min((1 - q) * s, width / float((1 - others).max()))
        down = min(q * s, width / float(others.max()))
        moved = up if draws[step] * (up + down) < down else -down
        step += 1
        chance[0] = q + moved / s
        chance[1:] = others - way * (moved / width)
        done = (chance <= 1e-9) | (chance >= 1 - 1e-9)
        if not done.any():  # rounding: the nearest is the one that was meant
            done[np.minimum(chance, 1 - chance).argmin()] = True
        for i in np.flatnonzero(done).tolist():
            bits[which[i]] = int(chance[i] > 0.5)
        which, size, chance = which[~done], size[~done], chance[~done]
    return bits, int(which[0]) if len(which) else -1, float(chance[0]) if len(which) else 0.0


def _rng(*key: int) -> np.random.Generator:
    return np.random.default_rng([int(k) & 0xFFFFFFFF for k in key])


def _first(seed: int):
    """Over a bucket of classes of equal rows: the whole part of a class's extra copies is dealt at once, the rest pivots."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _bucket(pdf, seed)

    return run


def _bucket(pdf: pd.DataFrame, seed: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["size", "order", "doc_id"], ascending=[False, True, True], kind="stable", na_position="last").reset_index(drop=True)
    mass = pdf["frac"].to_numpy() * pdf["n"].to_numpy()
    whole = np.floor(mass + 1e-12)
    sizes, probs, rng = pdf["size"].astype(float).tolist(), np.clip(mass - whole, 0, 1).tolist(), _rng(seed, pdf["sid"][0], pdf["bucket"][0])
    bits, held, p = pivot(sizes, probs, rng)
    pdf["extra"] = whole.astype("int64") + np.array(bits, dtype="int64")
    left = np.full(len(pdf), np.nan)
    if held >= 0:
        left[held] = p
    pdf["left"] = left
    return pdf[["sid", "bucket", "doc_id", "size", "n", "extra", "left"]]


def _next(last: bool, level: int, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "bucket"], ascending=[False, True], kind="stable").reset_index(drop=True)
        rng = _rng(seed, pdf["sid"][0], pdf["node"][0], level + 1)
        bits, held, p = pivot(pdf["size"].astype(float).tolist(), pdf["left"].tolist(), rng)
        left = np.full(len(pdf), np.nan)
        if held >= 0:
            if last:
                bits[held] = int(rng.random() < p)
            else:
                left[held] = p
        return pd.DataFrame({"sid": pdf["sid"], "bucket": pdf["bucket"], "size": pdf["size"], "bit": np.array(bits, dtype="int64"), "left": left})

    return run


def source_targets(rows: DataFrame, weights=WEIGHTS, cap: float = MAX_COPIES) -> DataFrame:
    """One row per source of rows(source, size, n): (sid, source, rows, source_size, target), staged.

    sid numbers the sources in code-point order, null last; weights repeat along it. Targets share all words by weight, none
    above cap times its source's size; the excess is reshared by weight until none is above. Sources stay
    distributed: they are numbered within ranges of the order, and the driver sees a count per range and the sums of each resharing.
    """
    found = rows.groupBy("source").agg(F.sum("n").alias("rows"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    ranged = staged(found.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "mix-ranges")
    before, offsets = 0, []
    for r in sorted(ranged.groupBy("part").agg(F.count("*").alias("n")).collect()):
        offsets.append((r["part"], before))
        before += r["n"]
    starts = rows.sparkSession.createDataFrame(offsets, "part int, before long")
    sid = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1 + F.col("before")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    numbered = ranged.join(F.broadcast(starts), "part").withColumn("sid", sid.cast("long")).withColumn("weight", weight).withColumn("most", F.col("source_size") * float(cap))
    numbered = staged(numbered, "mix-numbered")
    left = float(numbered.agg(F.sum("source_size")).first()[0] or 0)
    rate, closed = 0.0, F.lit(False)
    while left > 0:
        total = numbered.where(~closed).agg(F.sum("weight")).first()[0]
        if not total:
            break
        rate = left / total
        above = ~closed & (F.lit(rate) * F.col("weight") > F.col("most"))
        sums = numbered.where(above).agg(F.sum("most"), F.max("sid")).first()
        if sums[1] is None:
            break
        # a source that is above stays above, as every resharing raises the rate
        left, closed = left - sums[0], F.lit(rate) * F.col("weight") > F.col("most")
    target = F.least(F.lit(rate) * F.col("weight"), F.col("most"))
    out = staged(numbered.select("sid", "source", "rows", "source_size", target.alias("target")), "mix-sources")
    discard(ranged, numbered)
    return out


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = MAX_COPIES, bucket_rows: int = BUCKET_ROWS, fan_in: int = FAN_IN, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies.

    A null text has size 0, a null source is a source of its own, and equal rows are told apart by a
    running number, so a repeated row never fills one bucket. Documents of size 0 get no extra copy.
    Sources are a table of their own, joined like any other. An empty table gives no rows.
    Results depend on the rows alone, not on how they are dealt over tasks.
    """
    rows = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    classes = staged(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), "mix-classes")
    sources = source_targets(classes, weights, cap)
    most = math.ceil((sources.agg(F.max("rows")).first()[0] or 1) / bucket_rows)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    dealt = classes.join(sources.withColumnRenamed("source", "source_"), F.col("source_").eqNullSafe(F.col("source"))).drop("source_")
    dealt = dealt.withColumn("base", F.floor(rate)).withColumn("frac", rate - F.floor(rate)).withColumn("order", F.xxhash64("doc_id", "size"))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("order", F.lit(seed)), F.greatest(F.lit(1), F.ceil(F.col("rows") / bucket_rows))).cast("long"))
    first = staged(
        dealt.select("sid", "bucket", "doc_id", "size", "n", "frac", "order").groupBy("sid", "bucket").applyInPandas(_first(seed), "sid long, bucket long, doc_id long, size long, n long, extra long, left double"),
        "mix-level0",
    )
    left = first.where("left is not null and not isnan(left)").select("sid", "bucket", "size", "left")
    level, width, settled = 0, 1, []
    while True:
        width *= fan_in
        last = width >= most
        out = staged(
            left.withColumn("node", F.floor(F.col("bucket") / width).cast("long")).groupBy("sid", "node").applyInPandas(_next(last, level, seed), "sid long, bucket long, size long, bit long, left double"),
            f"mix-level{level + 1}",
        )
        settled.append(out.where("left is null or isnan(left)").select("sid", "bucket", "bit"))
        if last:
            break
        left, level = out.where("left is not null and not isnan(left)").select("sid", "bucket", "size", "left"), level + 1
    bits = settled[0]
    for more in settled[1:]:
        bits = bits.unionByName(more)
    whole = first.where("left is null or isnan(left)").withColumn("bit", F.lit(0).cast("long"))
    rest = first.where("left is not null and not isnan(left)").join(bits, ["sid", "bucket"])
    discard(classes)
    done = whole.unionByName(rest.select(whole.columns)).withColumn("extra", F.col("extra") + F.col("bit"))
    done = done.join(sources, "sid").withColumn("base", F.floor(rate).cast("long"))
    one = done.select("doc_id", "source", "size", "source_size", "target", "base", "extra", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i"))
    return one.select("doc_id", "source", "size", "source_size", "target", "i", (F.col("base") + (F.col("i") <= F.col("extra")).cast("long")).alias("copies"))


@columns_apart
def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """docs with every row as many times as mix() takes it; rows taken no time go, columns stay."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    plan = mix(docs, **options).groupBy(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z")).agg(F.min("copies").alias("_low"), F.sum("copies").alias("_sum"), F.count("*").alias("_n"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_z"))
    rows = docs.withColumn("_size", size).join(plan, same)
    once = rows.where("_n = 1").withColumn("_copies", F.col("_sum"))
    # repeated rows become a row with a count, so no window ever holds a hot row's repeats
    again = rows.where("_n > 1").groupBy(*docs.columns, "_d", "_s", "_z", "_low", "_sum", "_n").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("_d", "_s", "_z").orderBy("text").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spare = F.col("_sum") - F.col("_low") * F.col("_n") - before
    again = again.withColumn("_copies", F.col("_low") * F.col("_c") + F.least(F.greatest(spare, F.lit(0)), F.col("_c")))
    taken = once.select(*docs.columns, "_copies").unionByName(again.select(*docs.columns, "_copies")).where("_copies > 0")
    return taken.withColumn("_copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(docs.columns)
