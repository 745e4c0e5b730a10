"""Quality by a byte-level convolutional network in numpy.

Each byte has a learned vector; learned filters over 8 bytes step through the whole text by 2 bytes, in
chunks that overlap so that no position is lost. Each filter's largest value anywhere in the text is
kept, and a hidden layer combines these with the text's length into one probability.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import pieces, texts
from quire.llm.samples import best_cut, labelled, within

WIDTH, STEP, VECTOR, FILTERS, HIDDEN = 8, 2, 6, 24, 12
#: Positions of a text's end whose filters reach past it.
LAP = (WIDTH - STEP) // STEP
#: Positions a chunk computes at once; chunks overlap by WIDTH - STEP bytes.
CHUNK = 1 << 14
#: Labelled texts of a class that are learnt from, about, and the bytes of all of them together.
SAMPLE_PER_CLASS = 1500
SAMPLE_BYTES = 1 << 25
EPOCHS, BATCH, RATE = 8, 16, 4e-3
#: Batches that a small sample is gone through at least, and epochs at most.
LEAST_BATCHES, MOST_EPOCHS = 1500, 40
THRESHOLD = 0.7


class ByteNet:
    def __init__(self, seed: int = 8):
        rng = np.random.default_rng(seed)
        draw = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "vector": draw(0.5, 256, VECTOR), "filter": draw(1 / math.sqrt(WIDTH * VECTOR), WIDTH * VECTOR, FILTERS), "shift": np.zeros(FILTERS, np.float32),
            "hidden": draw(1 / math.sqrt(FILTERS), FILTERS, HIDDEN), "hidden_shift": np.zeros(HIDDEN, np.float32),
            "out": draw(1 / math.sqrt(HIDDEN), HIDDEN), "bias": np.zeros(1, np.float32),
        }

    def convolve(self, data: np.ndarray, chunk: int = CHUNK):
        """Yields (first position, values by filter) for chunks of an array of bytes; position i starts at byte i * STEP."""
        n = max(0, (len(data) - WIDTH) // STEP + 1)
        for at in range(0, n, chunk):
            end = min(n, at + chunk)
            x = self.p["vector"][data[at * STEP : (end - 1) * STEP + WIDTH]]
            windows = np.lib.stride_tricks.sliding_window_view(x.reshape(-1), WIDTH * VECTOR)[:: STEP * VECTOR]
            yield at, np.ascontiguousarray(windows) @ self.p["filter"]

    @staticmethod
    def lay(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All texts in one array, each starting at a step and followed by a filter's width of zeros; first position of each."""
        parts, first, at = [], [], 0
        for d in docs:
            room = WIDTH + (-(len(d) + WIDTH)) % STEP
            parts += [d, b"\x00" * room]
            first.append(at // STEP)
            at += len(d) + room
        return np.frombuffer(b"".join(parts), np.uint8), np.array(first)

    def pool(self, docs: list[bytes]) -> np.ndarray:
        """The largest value of each filter in each text."""
        data, first = self.lay(docs)
        out = np.full((len(docs), FILTERS), -np.inf, np.float32)
        across = (first[1:, None] - np.arange(1, LAP + 1)).ravel()  # windows that run into the next text
        for at, values in self.convolve(data):
            values[across[(across >= at) & (across < at + len(values))] - at] = -np.inf
            a = np.searchsorted(first, at, side="right") - 1
            b = np.searchsorted(first, at + len(values), side="left")
            starts = np.maximum(first[a:b], at) - at
            out[a:b] = np.maximum(out[a:b], np.maximum.reduceat(values, starts, axis=0))
        return out + self.p["shift"]

    def head(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        squashed = np.tanh(pooled)
        hidden = np.maximum(0, squashed @ self.p["hidden"] + self.p["hidden_shift"])
        return squashed, hidden, hidden @ self.p["out"] + self.p["bias"][0]

    def scores(self, docs: list[bytes]) -> np.ndarray:
        if not docs:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.head(self.pool(docs))[2].astype(np.float64), -30, 30)))

    def gradients(self, docs: list[bytes], y: np.ndarray) -> dict[str, np.ndarray]:
        data, first = self.lay(docs)
        top = np.full((len(docs), FILTERS), -np.inf, np.float32)
        where = np.zeros((len(docs), FILTERS), np.int64)
        n = max(0, (len(data) - WIDTH) // STEP + 1)
        ends = np.maximum(first + 1, np.r_[first[1:], n + LAP] - LAP)
        for at, values in self.convolve(data):  # a text may lie in several chunks: the first largest value counts
            for i in range(np.searchsorted(ends, at, side="right"), np.searchsorted(first, at + len(values), side="left")):
                part = values[max(0, first[i] - at) : ends[i] - at]
                k = part.argmax(0)
                found = part[k, np.arange(FILTERS)]
                better = found > top[i]
                top[i][better], where[i][better] = found[better], (k + max(at, first[i]))[better]
        squashed, hidden, z = self.head(top + self.p["shift"])
        g = {}
        dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)).astype(np.float32)
        g["bias"], g["out"] = np.array([dz.sum()], np.float32), hidden.T @ dz
        dh = np.outer(dz, self.p["out"]) * (hidden > 0)
        g["hidden_shift"], g["hidden"] = dh.sum(0), squashed.T @ dh
        dp = (dh @ self.p["hidden"].T) * (1 - squashed * squashed)
        g["shift"] = dp.sum(0)
        taken = data[(where * STEP)[:, :, None] + np.arange(WIDTH)]  # text, filter, byte
        x = self.p["vector"][taken].reshape(len(docs), FILTERS, WIDTH * VECTOR)
        g["filter"] = np.einsum("df,dfk->kf", dp, x)
        dx = (dp[:, :, None] * self.p["filter"].T[None]).reshape(len(docs), FILTERS, WIDTH, VECTOR)
        g["vector"] = np.zeros_like(self.p["vector"])
        np.add.at(g["vector"], taken.reshape(-1), dx.reshape(-1, VECTOR))
        return g

    def train(self, docs: list[bytes], y: np.ndarray, epochs: int = EPOCHS) -> None:
        """Adam over batches in a fixed shuffled order, the rate falling to nothing."""
        rng, step = np.random.default_rng(9), 0
        epochs = max(epochs, min(MOST_EPOCHS, math.ceil(LEAST_BATCHES * BATCH / max(1, len(docs)))))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        total = epochs * math.ceil(len(docs) / BATCH)
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for at in range(0, len(docs), BATCH):
                pick, step = order[at : at + BATCH], step + 1
                for k, g in self.gradients([docs[i] for i in pick], y[pick]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.99 * s[k] + 0.01 * g * g
                    rate = RATE * (1 - step / (total + 1))
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)

    def calibrate(self, docs: list[bytes], y: np.ndarray, counts: dict[int, int]) -> None:
        """Moves the bias so that the margin where the sample's classes part best scores THRESHOLD."""
        margins = np.concatenate([self.head(self.pool(docs[i : i + 64]))[2] for i in range(0, len(docs), 64)])
        self.p["bias"] = (self.p["bias"] + math.log(THRESHOLD / (1 - THRESHOLD)) - best_cut(margins, y, counts)).astype(np.float32)


def learn(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, most: int = SAMPLE_BYTES) -> ByteNet:
    """Trains on about per_class whole texts of each class from the training fold (crc32 of the id modulo 4 is not 2), as many as `most` bytes hold.

    The bias is then set where the sample's classes part best, at the classes' true counts. With one class or none the net stays as drawn.
    """
    rows, counts = labelled(docs, labels, "quality", 4, 2, per_class)
    got = sorted((r["doc_id"], r["y"], bytes(r["text"])) for r in within(rows, "text", most))
    net, y = ByteNet(), np.array([r[1] for r in got], np.float32)
    if len(set(y.tolist())) == 2:
        net.train([r[2] for r in got], y)
        net.calibrate([r[2] for r in got], y, counts)
    return net


def score(docs: DataFrame, net: ByteNet) -> DataFrame:
    """One row per row of docs: doc_id, score from 0 to 1. Whole texts are read; null and empty texts are scored as eight zero bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(net.p)

    def run(batches):
        own = ByteNet()
        own.p = shared.value
        for b in pieces(batches, 1 << 20):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own.scores(texts(b.column(1))), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
