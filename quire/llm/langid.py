"""Language ID by string kernels: presence of character n-grams of several lengths, Nyström landmarks, kernel ridge regression.

The kernel of two texts is the share of n-grams (1 to 3 bytes of the letters, blanks between words)
that both hold, normalised by the geometric mean of their counts. A bounded sample of labelled rows is
drawn; some of its texts are landmarks. The sample's kernels with the landmarks, whitened by the
landmarks' own kernel matrix (Nyström), are the features of a ridge regression for each language against
the rest. The model is one matrix, landmarks by languages, so a batch of texts is scored by two products:
presence times landmarks' presence, then kernels times weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import columns_apart, in_training_fold, pieces, texts
from quire.llm.samples import fraction

NGRAMS = (1, 2, 3)
BINS = 1 << 14
#: Labelled texts a language gives, about, and landmarks of them; nothing else in this operator is a sample.
SAMPLE_PER_LANGUAGE = 160
LANDMARKS_PER_LANGUAGE = 24
#: Languages that are learnt, those with most labelled rows, and texts of all of them together, about: what the driver holds.
MOST_LANGUAGES, SAMPLE_TEXTS = 200, 12_000
RIDGE = 1e-2
UNKNOWN = "und"
#: Below this value of the winning regression a text with as many distinct n-grams has no language as far as filtering goes. Unlike the
#: score the value doesn't depend on how many languages there are; shorter texts say too little to be rejected.
REJECT_BELOW, LEAST_GRAMS = 0.28, 60

#: ASCII letters lower-cased, other bytes of letters kept, all else blank.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def presence(text: bytes) -> np.ndarray:
    """Which of the hashed n-grams a text holds; runs of blanks count as one."""
    x = _FOLD[np.frombuffer(b" " + text + b" ", np.uint8)]
    blank = x == 32
    x = x[~(blank & np.r_[False, blank[:-1]])].astype(np.uint32)
    found = np.zeros(BINS, bool)
    h = np.zeros(len(x), np.uint32)
    for n in range(1, max(NGRAMS) + 1):
        if len(x) < n:
            break
        h = h[: len(x) - n + 1] * np.uint32(0x9E3779B1) + x[n - 1 :] + np.uint32(n)
        if n in NGRAMS:
            g = h ^ (h >> np.uint32(15))
            g *= np.uint32(0x85EBCA6B)
            found[g >> np.uint32(18)] = True
    return found


class KernelModel:
    """Landmarks' presence over the n-grams that any of them holds, and weights to each language."""

    def __init__(self, labels: list[str], columns: np.ndarray, landmarks: np.ndarray, weights: np.ndarray):
        self.labels, self.columns, self.landmarks, self.weights = labels, columns, landmarks, weights
        self.size = np.sqrt(np.maximum(1, landmarks.sum(0)))

    def kernels(self, batch: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(batch), self.landmarks.shape[1]), np.float32)
        for at in range(0, len(batch), 256):
            some = np.stack(batch[at : at + 256])
            own = np.sqrt(np.maximum(1, some.sum(1)))
            out[at : at + 256] = some[:, self.columns].astype(np.float32) @ self.landmarks / own[:, None] / self.size
        return out

    def values(self, batch: list[np.ndarray]) -> np.ndarray:
        """The regressions' values, a column per language: near 1 for texts like a language's, near 0 for others."""
        return self.kernels(batch) @ self.weights

    def scores(self, batch: list[np.ndarray]) -> np.ndarray:
        """One column per language, from 0 to 1, rows summing to 1: a soft maximum of the regressions' values."""
        if not self.labels or not batch:
            return np.zeros((len(batch), len(self.labels)))
        values = self.values(batch)
        e = np.exp(8 * (values - values.max(1, keepdims=True)))
        return e / e.sum(1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS_PER_LANGUAGE) -> KernelModel:
    """rows: (language, presence)."""
    rows = sorted(rows, key=lambda r: (r[0], r[1].tobytes()))
    labels = sorted({lang for lang, _ in rows})
    if not labels:
        return KernelModel([], np.zeros(0, int), np.zeros((0, 0), np.float32), np.zeros((0, 0)))
    found = [p for _, p in rows]
    chosen, taken = [], dict.fromkeys(labels, 0)
    for i in np.random.default_rng(2).permutation(len(rows)).tolist():
        if taken[rows[i][0]] < landmarks:
            taken[rows[i][0]] += 1
            chosen.append(i)
    marks = np.stack([found[i] for i in chosen])
    columns = np.flatnonzero(marks.any(0))
    model = KernelModel(labels, columns, np.ascontiguousarray(marks[:, columns].T.astype(np.float32)), np.zeros((len(chosen), len(labels))))
    own = model.kernels([found[i] for i in chosen]).astype(np.float64)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    kept = values > 1e-6 * values.max()
    whiten = vectors[:, kept] / np.sqrt(values[kept])
    x = model.kernels(found).astype(np.float64) @ whiten
    y = np.array([[1.0 if lang == label else 0.0 for label in labels] for lang, _ in rows])
    weight = 1 / y.sum(0)[y.argmax(1)]  # languages count alike
    xw = x * weight[:, None]
    model.weights = whiten @ np.linalg.solve(xw.T @ x + RIDGE * np.eye(x.shape[1]), xw.T @ y)
    return model


def sample(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> list[tuple[str, np.ndarray]]:
    """About per_language labelled training texts of each language (all, if there are no more) of the MOST_LANGUAGES with most rows; no other rows are learnt from.

    A row is chosen by the hash of its id and text against the share that per_language is of its language, so no
    task ranks rows, reruns agree, and rows of one id with different texts are different rows. Equal rows count once.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & in_training_fold(5, 0))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    place = fraction(F.col("doc_id").cast("string"), F.col("text").cast("string"), F.lit("langid"))
    found = sizes.orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    per_language = min(per_language, SAMPLE_TEXTS // max(1, len(found)))
    share = F.lit(-1.0)
    for r in found:  # a filter of a known size: no text is shuffled to be chosen
        share = F.when(F.col("lang") == r["lang"], per_language / r["n"]).otherwise(share)
    picked = rows.where(place < share)
    picked = picked.select("lang", F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("h"))

    def run(batches):
        for b in pieces(batches, 1 << 20):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.packbits(presence(t)).tobytes() for t in texts(b.column(1))], pa.binary())], ["lang", "bits"])

    got = picked.dropDuplicates(["lang", "h"]).select("lang", "text").mapInArrow(run, "lang string, bits binary").collect()
    return [(r["lang"], np.unpackbits(np.frombuffer(r["bits"], np.uint8)).astype(bool)) for r in got]


def identify(docs: DataFrame, model: KernelModel) -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score.

    Whole texts are scored. Null texts and texts without a letter are `und` with score 0, and so is every
    text if no labelled row was there to learn from. Equal texts get equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in pieces(batches, 1 << 20):
            letters = b.column(2).to_pylist()
            scores = m.scores([presence(t) for t in texts(b.column(1))])
            best = scores.argmax(1) if m.labels else np.zeros(b.num_rows, int)
            known = [bool(x) and bool(m.labels) for x in letters]
            pred = [m.labels[i] if k else UNKNOWN for i, k in zip(best.tolist(), known)]
            score = [float(s[i]) if k else 0.0 for s, i, k in zip(scores, best, known)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), text, F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def learn(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> KernelModel:
    return fit(sample(docs, per_language))


@columns_apart
def reject_unknown(docs: DataFrame, model: KernelModel, below: float = REJECT_BELOW) -> DataFrame:
    """docs without the rows that get no language: no letter, or text like none of the languages; columns stay, and so do clean rows of any language.

    Texts of several languages are like each of them. With nothing learnt only texts without a letter go.
    """
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def run(batches):
        m = shared.value
        at = names.index("text")
        for b in pieces(batches, 1 << 20, at):
            keep = b.column(len(names)).to_pylist()
            if m.labels:
                found = [presence(t) for t in texts(b.column(at))]
                best = m.values(found).max(1)
                keep = [k and (v >= below or p.sum() < LEAST_GRAMS) for k, v, p in zip(keep, best.tolist(), found)]
            yield b.select(names).filter(pa.array(keep, pa.bool_()))

    letters = F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)).alias("_letters")
    return docs.select("*", letters).mapInArrow(run, docs.schema)
