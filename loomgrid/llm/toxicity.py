"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are a text's distinct words, pairs of neighbours, and pairs with one word between, hashed to 2**BITS places.
FTRL-proximal keeps a learning rate per coordinate, and its L1 term leaves most weights at exactly zero; what remains
is small enough to go to every worker.

The model is fitted on a bounded sample of labelled rows: the `max_rows` of the least hashes of their ids, in that
order, in one task; of an id in many rows no more than that come to it either. Scoring covers every document and its whole text, in one map without a shuffle.

Defined results: a null or empty text, or one without words, isn't toxic; labels that are null, and labels of ids
without a document, are not used; a null id is scored and kept; repeated rows are scored one by one; without labelled rows all weights are
zero and nothing is toxic (a text without weighted features scores 0); a score equal to the threshold isn't toxic; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm.common import arrow_map, pick, words

BITS, MAX_ROWS, EPOCHS, THRESHOLD = 22, 20_000, 8, 0.3
ALPHA, BETA, L1, L2 = 4.0, 1.0, 4.0, 0.0
#: A sample's ids go to every worker up to this many rows; beyond it they are joined by a shuffle.
BROADCAST_ROWS, KNOWN = 200_000, 200_000
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


class Hashes(dict):
    """Word -> 64-bit hash, up to KNOWN words; then others are hashed each time."""

    def __missing__(self, w: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(w)
        if len(self) < KNOWN:
            self[w] = h
        return h


def features(text: str | None, known: Hashes, bits: int = BITS) -> np.ndarray:
    """Places of all n-grams and skip-grams of the text, with repeats."""
    w = words(text) if text else []
    h = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
    parts = [h * MIX[0], h[:-1] * MIX[1] + h[1:] * MIX[0], h[:-2] * MIX[2] + h[2:] * MIX[3]]
    every = np.concatenate(parts)
    every ^= every >> np.uint64(31)
    every *= MIX[1]
    return (every >> np.uint64(64 - bits)).astype(np.int64)


class Ftrl:
    """Per-coordinate FTRL-proximal; place 0 of the extra end is the bias, which isn't regularised."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n, self.bias = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1), 1 << bits
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == self.bias, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, y: int) -> None:
        """at: distinct places."""
        at = np.append(at, self.bias)
        w = self.weights(at)
        g = sigmoid(w.sum()) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", label_id: str = "doc_id", max_rows: int = MAX_ROWS, epochs: int = EPOCHS, bits: int = BITS) -> dict[int, float]:
    """Place -> weight, of the weights that aren't zero; place 2**bits is the bias."""
    known = pick(labels, id=labels[label_id].cast("long"), y=labels[label_col].cast("int")).filter("id is not null and y is not null")
    some = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = pick(docs, id=docs[id_col].cast("long"), text=docs[text_col].cast("string")).filter("text is not null")
    joined = texts.join(F.broadcast(some) if max_rows <= BROADCAST_ROWS else some, "id").select("id", "y", "text")

    def learn(batches):
        model, rows, hashes = Ftrl(bits), [], Hashes()
        for batch in batches:
            rows += [(y, np.unique(features(t, hashes, bits)).astype(np.int32)) for y, t in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist())]
        for _ in range(epochs):
            for y, at in rows:
                model.learn(at, y)
        every = np.arange(model.bias + 1)
        w = model.weights(every)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at], pa.float64())], ["place", "weight"])

    first = [F.xxhash64("id"), F.col("id"), F.xxhash64("text"), F.col("text")]
    one = joined.orderBy(*first).limit(max_rows).repartition(1).sortWithinPartitions(*first)
    return {r["place"]: r["weight"] for r in one.mapInArrow(learn, "place long, weight double").collect()}


def scores(docs: DataFrame, weights: dict[int, float], id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """doc_id, score of every document."""
    at = np.fromiter(sorted(weights), np.int64, len(weights))
    w = np.fromiter((weights[k] for k in at.tolist()), np.float64, len(at))
    made: list = []

    def run(batch: pa.RecordBatch) -> dict:
        if not made:
            full = np.zeros((1 << bits) + 1, np.float32)
            full[at] = w
            made.extend((Hashes(), full))
        hashes, full = made
        out = []
        for t in batch.column("text").to_pylist():
            f = features(t, hashes, bits)
            f = np.unique(f[full[f] != 0])
            out.append(sigmoid(float(full[f].sum(dtype=np.float64)) + float(full[-1])) if t and len(f) else 0.0)
        return {"doc_id": batch.column("doc_id"), "score": out}

    return arrow_map(pick(docs, doc_id=docs[id_col].cast("long"), text=docs[text_col].cast("string")), run, "doc_id long, score double")


def toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, score of the documents whose score passes the threshold."""
    weights = fit(docs, labels, **options)
    own = {k: v for k, v in options.items() if k in ("id_col", "text_col", "bits")}
    return scores(docs, weights, **own).filter(F.col("score") > threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
