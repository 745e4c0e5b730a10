"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words, word pairs and pairs with a word between, hashed to 2 ** 20
places. The learner keeps for each place a sum of gradients and of their squares: rates fall with what
a feature has seen, and L1 leaves most weights at zero. The weights that remain are a short list of
(place, weight), broadcast to score whole texts in numpy.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import pieces, texts
from quire.llm.samples import best_cut, labelled, within

BITS = 20
#: Labelled texts of a class that are learnt from, about, and the bytes of all their features (four for each) together.
SAMPLE_PER_CLASS = 3000
SAMPLE_BYTES = 1 << 28
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 8.0, 0.1, 3
THRESHOLD = 0.5

#: ASCII letters lower-cased, digits and the bytes of other letters kept, all else parts words (zero).
_FOLD = np.zeros(256, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_POWERS = np.ones(1 << 12, np.uint64)
for _i in range(1, len(_POWERS)):
    _POWERS[_i] = np.uint64((int(_POWERS[_i - 1]) * 0x100000001B3) & (2**64 - 1))


def features(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, place) of every word, pair and skip pair; repeats included."""
    data = _FOLD[np.frombuffer(b"\x00".join([*docs, b""]), np.uint8)]
    inside = data > 0
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, np.diff(at) > 1])
    starts = at[first]
    place = (at - np.repeat(starts, np.diff(np.r_[first, len(at)]))) % len(_POWERS)
    h = np.add.reduceat(data[at].astype(np.uint64) * _POWERS[place], first)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    ends = np.cumsum([len(d) + 1 for d in docs])
    doc = np.searchsorted(ends, starts, side="right")
    found, owner = [h], [doc]
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        same = doc[gap:] == doc[:-gap]
        pair = (h[:-gap] * np.uint64(salt)) ^ (h[gap:] + np.uint64(salt & 0xFFFF))
        pair ^= pair >> np.uint64(29)
        pair *= np.uint64(0x94D049BB133111EB)
        found.append(pair[same])
        owner.append(doc[gap:][same])
    return np.concatenate(owner), (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """Per-coordinate FTRL-proximal with L1 and L2."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)  # the last is the bias

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, at: np.ndarray, y: int) -> None:
        """at: distinct places; the bias is added."""
        at = np.r_[at, len(self.z) - 1]
        w = self.weights(at)
        g = 1 / (1 + math.exp(-max(-30.0, min(30.0, w.sum())))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] += g * g


def fit(rows: list[tuple[np.ndarray, int]], counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray, float]:
    """rows: (distinct places, label) in any order. Returns places, weights, bias; the bias is set where the sample's classes part best, at the classes' true counts."""
    model = Ftrl(1 << BITS)
    rows = sorted(rows, key=lambda r: (r[1], len(r[0]), r[0].tobytes()))
    rng = np.random.default_rng(5)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)).tolist():
            model.learn(*rows[i])
    w = model.weights(np.arange(len(model.z)))
    at = np.flatnonzero(w[:-1])
    bias = float(w[-1])
    if all(counts.get(y) and any(r[1] == y for r in rows) for y in (0, 1)):
        bias = -best_cut(np.array([w[r[0]].sum() for r in rows]), np.array([r[1] for r in rows]), counts)
    return at, w[at].astype(np.float32), bias


def learn(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, most: int = SAMPLE_BYTES) -> tuple[np.ndarray, np.ndarray, float]:
    """Fits on about per_class whole texts of each class from the training fold (crc32 of the id modulo 5 is not 0), as many as `most` bytes of features hold."""
    rows, counts = labelled(docs, labels, "toxic", 5, 0, per_class)

    def run(batches):
        for b in pieces(batches, 1 << 20):
            data = texts(b.column(1))
            owner, place = features(data)
            pair = np.unique(owner << BITS | place)
            cut = np.searchsorted(pair >> BITS, np.arange(len(data) + 1))
            bits = [(pair[cut[i] : cut[i + 1]] & ((1 << BITS) - 1)).astype("<u4").tobytes() for i in range(len(data))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits, pa.binary()), b.column(2), b.column(3)], ["doc_id", "places", "y", "place"])

    named = rows.select(F.col("doc_id").cast("long"), "text", "y", "place")
    got = within(named.mapInArrow(run, "doc_id long, places binary, y int, place double"), "places", most)
    return fit([(np.frombuffer(r["places"], "<u4").astype(np.int64), r["y"]) for r in got], counts)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """One row per row of docs: doc_id, score from 0 to 1. Null and empty texts have no features and get the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        at, w, bias = shared.value
        dense = np.zeros(1 << BITS, np.float32)
        dense[at] = w
        for b in pieces(batches, 1 << 20):
            data = texts(b.column(1))
            owner, place = features(data)
            some = dense[place] != 0
            pair = np.unique(owner[some] << BITS | place[some])
            total = np.bincount(pair >> BITS, weights=dense[pair & ((1 << BITS) - 1)], minlength=len(data)) + bias
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
