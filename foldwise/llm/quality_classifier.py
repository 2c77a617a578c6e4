"""A byte-level convolutional network for text quality, in numpy.

General texts with an id and labels for some of them.  A text is cut into chunks of
bytes that overlap by the width of the filters less one step, so every window of the
whole text lies in one chunk.  Bytes have learned vectors; learned filters run over
each chunk; every filter keeps its largest answer per chunk (max-pooling).  Chunks
are combined by the mean and the maximum of those answers, and a logistic layer gives
one probability per text.

Training takes a bounded sample: at most ``max_docs`` labelled texts of at most
``max_bytes`` bytes in all, the first by hash of the id, which is no choice by
content.  One task trains on them; weights (some tens of kB) go to the scoring tasks.
Scoring covers all texts in the scan, without a shuffle.

Defined results: NULL and empty texts get the score of a text without windows; rows
with equal ids are scored alike if their texts are; labels that are NULL teach
nothing; without any label every score is 0.5.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from foldwise.llm.words import slices
from foldwise.operators.storage import materialize

WIDTH, STEP, VECTOR, FILTERS = 8, 4, 8, 32
CHUNK_WINDOWS = 256  # windows per chunk: 1,024 bytes and the overlap


def _windows(data: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """One row of ``WIDTH * VECTOR`` numbers per window; a short text is padded by zero bytes."""
    n = max(0, -(-(len(data) - WIDTH) // STEP)) + 1
    padded = np.zeros((n - 1) * STEP + WIDTH, dtype=np.uint8)
    padded[:len(data)] = data
    halves = vectors[padded].reshape(-1, STEP * VECTOR)
    return np.concatenate([halves[:-1], halves[1:]], axis=1)


def _pool(answers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest answer of each filter per chunk, and the windows where they are."""
    starts = np.arange(0, len(answers), CHUNK_WINDOWS)
    at = np.stack([answers[s:s + CHUNK_WINDOWS].argmax(axis=0) + s for s in starts])
    return np.take_along_axis(answers, at, axis=0), at


def _features(pooled: np.ndarray) -> np.ndarray:
    return np.concatenate([pooled.mean(axis=0), pooled.max(axis=0)])


class Network:
    """Byte vectors, filters with offsets, and the logistic layer."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {"vectors": rng.normal(0, 0.5, (256, VECTOR)), "filters": rng.normal(0, 0.3, (WIDTH * VECTOR, FILTERS)),
                  "offsets": np.zeros(FILTERS), "weights": np.zeros(2 * FILTERS), "bias": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def answers(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = _windows(data, self.p["vectors"])
        return x, np.tanh(x @ self.p["filters"] + self.p["offsets"])

    def score(self, data: np.ndarray) -> float:
        """Probability of a text; works in blocks of chunks, so memory does not grow with it."""
        block, total, top, n = CHUNK_WINDOWS * STEP * 64, np.zeros(FILTERS), np.full(FILTERS, -np.inf), 0
        for at in range(0, max(1, len(data) - WIDTH + STEP), block):
            x = _windows(data[at:at + block + WIDTH - STEP], self.p["vectors"])
            raw = x @ self.p["filters"]
            pooled = np.tanh(np.maximum.reduceat(raw, np.arange(0, len(raw), CHUNK_WINDOWS), axis=0) + self.p["offsets"])
            total, top, n = total + pooled.sum(axis=0), np.maximum(top, pooled.max(axis=0)), n + len(pooled)
        z = np.concatenate([total / n, top]) @ self.p["weights"] + self.p["bias"][0]
        return float(1 / (1 + np.exp(-z)))

    def gradient(self, data: np.ndarray, label: float) -> dict:
        x, answers = self.answers(data)
        pooled, at = _pool(answers)
        f = _features(pooled)
        d = 1 / (1 + np.exp(-(f @ self.p["weights"] + self.p["bias"][0]))) - label
        back = np.zeros_like(pooled)
        back += d * self.p["weights"][:FILTERS] / len(pooled)
        back[pooled.argmax(axis=0), np.arange(FILTERS)] += d * self.p["weights"][FILTERS:]
        back *= 1 - pooled ** 2
        rows, columns, g = at.ravel(), np.tile(np.arange(FILTERS), len(at)), back.ravel()
        spots, place = np.unique(rows, return_inverse=True)
        sparse = np.zeros((len(spots), FILTERS), dtype=np.float32)
        np.add.at(sparse, (place, columns), g)
        dx = (sparse @ self.p["filters"].T).reshape(-1, VECTOR)
        padded = np.zeros(spots[-1] * STEP + WIDTH, dtype=np.uint8)
        padded[:len(data)] = data[:len(padded)]
        touched = padded[(spots[:, None] * STEP + np.arange(WIDTH)).ravel()]
        dv = np.stack([np.bincount(touched, dx[:, k], minlength=256) for k in range(VECTOR)], axis=1)
        return {"vectors": dv, "filters": x[spots].T @ sparse, "offsets": sparse.sum(axis=0), "weights": d * f, "bias": np.array([d])}

    def fit(self, texts: list, labels: list, epochs: int = 6, batch: int = 16, rate: float = 0.01, seed: int = 7) -> None:
        """Adam on the log loss; labels count as they are, so probabilities follow their shares."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t, steps = 0, epochs * -(-len(texts) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for a in range(0, len(order), batch):
                chosen = order[a:a + batch]
                parts = [self.gradient(texts[i], labels[i]) for i in chosen]
                t += 1
                now = rate * max(0.05, 1 - t / steps)
                for k in self.p:
                    g = sum(p[k] for p in parts).astype(np.float32) / len(chosen)
                    m[k], s[k] = 0.9 * m[k] + 0.1 * g, 0.999 * s[k] + 0.001 * g * g
                    self.p[k] -= (now * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(s[k] / (1 - 0.999 ** t)) + 1e-7)).astype(np.float32)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.p)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Network:
        net = cls()
        with np.load(io.BytesIO(data)) as stored:
            net.p = {k: stored[k] for k in stored.files}
        return net


def _trainer(options: dict):
    def run(batches):
        texts, labels = [], []
        for batch in batches:
            labels += batch.column(1).to_pylist()
            for lo, hi, data, bounds in slices(batch.column(0)):
                texts += [data[a:b].copy() for a, b in zip(bounds[:-1], bounds[1:])]
        if texts:
            net = Network()
            net.fit(texts, labels, **options)
            yield pa.RecordBatch.from_arrays([pa.array([net.dump()], type=pa.binary())], ["weights"])

    return run


def train(labelled: DataFrame, order: Column, max_docs: int = 4000, max_bytes: int = 16 << 20, **options) -> bytes | None:
    """Weights learned from ``labelled(text, label)``; None without labels.

    ``order`` ranks the rows for the bound; the task that trains holds the sample only.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    light = labelled.where("label is not null").withColumn("_order", order)
    # A bounded sample: the first rows by hash, then as many of them as the bytes allow.
    first = light.orderBy("_order").limit(max_docs)
    from pyspark.sql import Window

    within = first.withColumn("_bytes", F.sum(size).over(Window.orderBy("_order"))).where((F.col("_bytes") <= max_bytes) | (F.col("_bytes") == size))
    rows = within.select("text", F.col("label").cast("double").alias("label")).mapInArrow(_trainer(options), "weights binary").collect()
    return bytes(rows[0][0]) if rows else None


def _scorer(weights: bytes | None, kind):
    def run(batches):
        net = Network.load(weights) if weights else None
        for batch in batches:
            scores = np.full(batch.num_rows, 0.5)
            if net:
                for lo, _, data, bounds in slices(batch.column(1)):
                    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                        scores[lo + i] = net.score(data[a:b])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(kind), pa.array(scores)], ["id", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                  learn_from: Column | None = None, cut: float = 0.7, **options) -> DataFrame:
    """One row per input row: ``id, score, predicted``; 1 is the label 1.

    Only rows that ``learn_from`` (a condition on the id) allows teach the network.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("label is not null")
    if learn_from is not None:
        marks = marks.where(learn_from)
    # The sample is chosen among the light label rows; then only its texts are read.
    order = F.xxhash64(F.col("id").cast("string"), F.lit("sample"))
    limit = options.get("max_docs", 4000)
    chosen = materialize(marks.groupBy("id").agg(F.max("label").alias("label")).orderBy(order, "id").limit(limit))
    labelled = named.join(F.broadcast(chosen), "id")
    weights = train(labelled, F.xxhash64(F.col("id").cast("string"), F.lit("sample")), **options)
    kind = named.schema["id"].dataType
    scored = named.mapInArrow(_scorer(weights, to_arrow_type(kind)), f"id {kind.simpleString()}, score double")
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
