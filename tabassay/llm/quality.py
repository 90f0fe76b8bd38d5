"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Terms are three-character shapes (letters by case, digits, blanks and each punctuation mark for itself)
and how often a word has already been seen in its text. Term weights are damped counts times inverse
document frequency; a truncated SVD of the labelled sample gives the latent space. The labelled vectors
are broadcast (their number is a parameter), every document's exact cosines with all of them are
computed in blocks, and the nearest vote with weights that grow with similarity.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabassay.llm.common import by_bytes
from tabassay.operators.frames import hash_sample

#: Labelled rows that the classifier is fitted on at most, taken in the order of a hash of their ids.
SAMPLE = 4000
RANK = 48
NEIGHBOURS = 25
POWER = 8
TERMS = 4096
REPEATS = 16
THRESHOLD = 0.3

_BLOCK = 1 << 20


def _shapes() -> np.ndarray:
    """byte -> class: lower and upper letters, digits, blank, line break, each punctuation mark, other bytes."""
    table = np.zeros(256, np.uint32)
    for byte in range(256):
        c = chr(byte)
        if byte >= 128:
            table[byte] = 1
        elif c.islower():
            table[byte] = 1
        elif c.isupper():
            table[byte] = 2
        elif c.isdigit():
            table[byte] = 3
        elif c in "\n\r":
            table[byte] = 4
        elif c.isspace():
            table[byte] = 5
        elif c.isprintable():
            table[byte] = 6 + sum(not chr(b).isalnum() and b > 32 for b in range(byte))
    return table


SHAPES = _shapes()
CLASSES = int(SHAPES.max()) + 1
_BUCKETS = ((np.arange(CLASSES**3, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.uint16)


def term_counts(text: str | None) -> np.ndarray:
    """Counts of TERMS hashed shapes and REPEATS levels of repetition, over the whole text."""
    data = (text or "").encode()
    counts = np.zeros(TERMS + REPEATS, np.float64)
    for at in range(0, max(len(data) - 2, 0), _BLOCK):
        c = SHAPES[np.frombuffer(data, np.uint8, min(_BLOCK + 2, len(data) - at), at)]
        counts[:TERMS] += np.bincount(_BUCKETS[(c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]], minlength=TERMS)
    words = Counter(data.split())
    if words:
        seen = np.bincount(np.fromiter(words.values(), np.int64, len(words)))
        share = np.arange(len(seen)) * seen
        level = np.minimum(np.log2(np.arange(1, len(seen))).astype(int), REPEATS - 1) if len(seen) > 1 else []
        np.add.at(counts, TERMS + np.asarray(level, int), share[1:])
    return counts


def matrix(texts: list[str | None]) -> np.ndarray:
    """Damped relative counts, a row per text."""
    out = np.empty((len(texts), TERMS + REPEATS), np.float32)
    for k, text in enumerate(texts):
        counts = term_counts(text)
        shapes, repeats = counts[:TERMS].sum(), counts[TERMS:].sum()
        counts[:TERMS] /= max(shapes, 1)
        counts[TERMS:] /= max(repeats, 1)
        out[k] = np.sqrt(counts)
    return out


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Model:
    """The latent space and the labelled vectors in it."""

    def __init__(self, x: np.ndarray, labels: list[int], rank: int = RANK, neighbours: int = NEIGHBOURS):
        self.idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
        x = unit_rows(x * self.idf)
        rng = np.random.default_rng(7)
        q = np.linalg.qr(x.T @ (x @ rng.standard_normal((x.shape[1], min(rank + 16, len(x)))).astype(np.float32)))[0]
        for _ in range(3):
            q = np.linalg.qr(x.T @ (x @ q))[0]
        _, s, vt = np.linalg.svd(x @ q, full_matrices=False)
        self.space = np.ascontiguousarray((q @ vt.T)[:, : min(rank, len(s))], np.float32)
        self.vectors, self.labels = unit_rows(x @ self.space).astype(np.float32), np.asarray(labels, np.float32)
        self.neighbours = min(neighbours, len(x))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for at in range(0, len(texts), 256):
            z = unit_rows(unit_rows(matrix(texts[at : at + 256]) * self.idf) @ self.space)
            cosines = z @ self.vectors.T
            near = np.argpartition(-cosines, self.neighbours - 1, axis=1)[:, : self.neighbours]
            weight = np.maximum(np.take_along_axis(cosines, near, axis=1), 1e-3).astype(np.float64) ** POWER
            out[at : at + 256] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        return np.clip(out, 0.0, 1.0)


class Constant:
    """Stands in where no label can be learned from."""

    def __init__(self, value: float):
        self.value = value

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return np.full(len(texts), self.value)


def held_out(key: Column, folds: int = 5, fold: int = 0) -> Column:
    """crc32 of the id as text modulo ``folds`` is ``fold``; false for a null id."""
    return F.coalesce(F.crc32(key.cast("string")) % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, test: Column, *, key: str, text: str, sample: int) -> DataFrame:
    """``text, label`` of at most ``sample`` labelled rows outside the held-out fold; that bound is also the broadcast's."""
    drawn = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~test).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("label"))
    drawn = hash_sample(drawn, ["key"], sample)
    found = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).join(F.broadcast(drawn), "key")
    return found


def term_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, label and the terms of a text that aren't 0: their numbers and weights."""
    for batch in by_bytes(batches, 2):
        x = matrix(batch.column(2).to_pylist())
        terms = [np.flatnonzero(row).astype(np.uint16) for row in x]
        columns = [batch.column(0), batch.column(1), pa.array([t.tobytes() for t in terms], pa.binary()), pa.array([row[t].tobytes() for row, t in zip(x, terms, strict=True)], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "label", "terms", "weights"])


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model | Constant:
    """Fitted on the driver from a bounded sample, whose terms the executors extract. One class or none: a constant."""
    drawn = labelled_sample(docs, labels, label, held_out(F.col(key)), key=key, text=text, sample=sample).select("key", "label", "text")
    kind = docs.schema[key].dataType.simpleString()
    rows = drawn.mapInArrow(term_batches, f"key {kind}, label int, terms binary, weights binary").collect()
    rows = sorted({r["key"]: r for r in rows}.values(), key=lambda r: r["key"])
    if len({r["label"] for r in rows}) < 2:
        return Constant(float(rows[0]["label"]) if rows else 0.5)
    x = np.zeros((len(rows), TERMS + REPEATS), np.float32)
    for k, r in enumerate(rows):
        x[k, np.frombuffer(r["terms"], np.uint16)] = np.frombuffer(r["weights"], np.float32)
    return Model(x, [r["label"] for r in rows])


def score_batches(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, 1):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.scores(batch.column(1).to_pylist()), pa.float64())], names=["key", "score"])


def score_quality(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """``key, held_out, score, predicted`` per row of ``docs``; only whole texts enter a score.

    Null and empty texts have no terms and get the vote of the neighbours at cosine 0. Repeated rows and
    null keys each give their row (a null key is not held out). Labels that are null or have no document are passed over, of
    repeated ones the larger counts; without two classes to learn from every score is the one class seen,
    or 0.5. Empty tables give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs, labels, key=key, text=text, label=label, sample=sample))
    kind = docs.schema[key].dataType.simpleString()
    scored = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(lambda it: score_batches(it, model), f"key {kind}, score double")
    return scored.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
