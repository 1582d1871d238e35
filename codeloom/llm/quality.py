"""Quality classification by logistic regression over hashed word n-grams.

A text's words and word pairs, as written in lower case and as shapes (runs of capitals, small
letters, digits, other signs), are hashed to ``2**BITS`` weights; a text is the count of each over the
square root of all, and its score the logistic of the sparse dot product. Training takes at most
about ``TRAIN_ROWS`` labelled rows, chosen by a hash, deals them to ``SHARDS`` tasks that each follow
the regularised leader coordinate by coordinate, and averages the shards' weights, so one fixed-size
vector a shard reaches the driver.

Edge cases: null and empty texts score by the bias alone; labels without a document, documents
without a label and null labels teach nothing; of repeated labels of a document the mean is taken,
one half counting as 1; with no labels every score is 0.5. Other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, doc_remainder, mix, settle, texts_of

BITS = 18
TRAIN_ROWS = 20_000
SHARDS = 4
EPOCHS = 6
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.02
_RUNS = ((re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[0-9]+"), b"0"), (re.compile(rb"(.)\1+"), rb"\1\1"))
_SHAPE = np.uint64((1 << BITS) - 1)
_EQUAL = 1  # the weight of a word that follows itself


class _Words(WordHashes):
    """The hash of each word in lower case, its lowest bits a hash of its shape."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        shape = word
        for run, sign in _RUNS:
            shape = run.sub(sign, shape)
        low = xxhash.xxh3_64_intdigest(shape, 1) & int(_SHAPE)
        value = self[word] = xxhash.xxh3_64_intdigest(word.lower()) & ~int(_SHAPE) | low
        return value


_hashes = _Words()


def features(text: bytes) -> np.ndarray:
    """The weights that a text touches, repeats included.

    They are its words, its word pairs, the shapes of both, and words that follow themselves.
    """
    h = _hashes.of(text.split())
    shape, word = h & _SHAPE, h & ~_SHAPE
    step = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        hashed = np.concatenate([mix(word), mix(word[:-1] * step + word[1:]), mix(shape), mix((shape[:-1] + np.uint64(7)) * step + shape[1:])])
    found = (hashed >> np.uint64(64 - BITS)).astype(np.int64)
    return np.append(found, np.full(int((word[1:] == word[:-1]).sum()), _EQUAL))


class Leader:
    """Follow-the-regularised-leader updates of single weights."""

    def __init__(self):
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        w = (np.sign(z) * L1 - z) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (_logistic(float(w @ x)) - label) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def _logistic(x: float) -> float:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _sparse(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    found = features(text)
    at, n = np.unique(found, return_counts=True)
    return np.append(at, 1 << BITS), np.append(n / np.sqrt(max(1, len(found))), 1.0)


def _train_shard(rows: pa.Table) -> pa.Table:
    order = np.argsort(rows["place"].to_numpy(), kind="stable")
    labels = rows["label"].to_numpy()
    leader = Leader()
    vectors = [_sparse(x) for x in texts_of(rows["text"])]
    for _ in range(EPOCHS):
        for k in order:
            leader.learn(*vectors[k], int(labels[k]))
    w = leader.weights(slice(None)).astype(np.float32)
    return pa.table({"n": pa.array([len(rows)], pa.int64()), "w": pa.array([w.tobytes()], pa.binary())})


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """The weights, the bias last, from labelled rows of ``docs`` where ``learn`` holds."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(learn).groupBy(F.col(id_col).alias("_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    n = marked.count()
    place = F.pmod(F.xxhash64("_id"), F.lit(1 << 30))
    share = min(1.0, train_rows / max(1, n))
    chosen = settle(marked.withColumn("place", place).where(F.col("place") < share * (1 << 30)), "train-labels")
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))  # about TRAIN_ROWS rows
    shards = rows.select("text", "label", "place", F.pmod("place", F.lit(SHARDS)).alias("shard")).groupBy("shard").applyInArrow(_train_shard, "n long, w binary").collect()
    w = np.zeros((1 << BITS) + 1)
    for r in shards:
        w += np.frombuffer(r["w"], np.float32) * (r["n"] / sum(x["n"] for x in shards))
    return w.astype(np.float32)


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            found = map(features, texts_of(batch["text"]))
            scores = [float(_logistic(w[x].sum(dtype=np.float64) / np.sqrt(max(1, len(x))) + float(w[-1]))) for x in found]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.record_batch([*(batch[c] for c in names), pa.array(scores, pa.float64())], names=[*names, "score"])

    return run


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` with their score."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    rows = docs.select(*(keep or []), F.col(text_col).alias("text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "score double"])
    return rows.mapInArrow(_scored(shared), schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each document."""
    held = doc_remainder(F.col("doc_id"), 5) == 0
    weights = train(docs, labels, ~held)
    scored = score(docs.withColumn("_held_out", held), weights, keep=["doc_id", "_held_out"])
    return scored.select("doc_id", F.col("_held_out").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
