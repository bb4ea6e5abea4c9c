"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams.

Features are the distinct hashed words, their first four and six bytes (so that
an unseen ending of a learned stem still counts), word pairs and pairs with one
word between them. Per-coordinate learning rates and the L1 term leave few weights
that are not zero; those alone are sent to the executors.

The model is fitted on at most ``MAX_TRAIN`` labelled rows, chosen by the order
of a hash of their id; scoring takes every whole text.

Defined results: a null or empty text has no features and gets the intercept's
score; rows without a label are not learned from; a repeated label of one
document counts once, the larger value; without any label every score is 0; a null
id is never learned from and counts as the empty text in the split; rows of equal
hash are learned in the order of label and text; a score of exactly 0.5 is toxic;
repeated rows give repeated scores; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as w

BITS = 20
MAX_TRAIN = 20_000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.0


def held_out(key) -> F.Column:
    """True where crc32 of the id as text leaves 0 when divided by 5."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 5 == 0


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every occurrence in a block of texts."""
    t = w.words(texts)
    n = len(t.h)
    row = np.repeat(np.arange(len(t.at) - 1, dtype=np.int32), np.diff(t.at))
    shift = np.uint64(64 - BITS)
    rows, found = [row] * 3, [t.h >> shift, t.prefix(4) * np.uint64(0x9FB21C651E98DF25) >> shift, t.prefix(6) * np.uint64(0xD1B54A32D192ED03) >> shift]
    for gap, a, b in ((1, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9), (2, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)):
        if n > gap:
            same = row[gap:] == row[:-gap]
            found.append((w.mix(t.h[:-gap] * np.uint64(a) + t.h[gap:] * np.uint64(b)) >> shift)[same])
            rows.append(row[gap:][same])
    return np.concatenate(rows), np.concatenate(found).astype(np.int32)


class Ftrl:
    """Per-coordinate FTRL-proximal state for logistic loss; the last weight is the intercept."""

    def __init__(self, size: int = (1 << BITS) + 1) -> None:
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, i: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        l1 = np.full(len(z), L1)
        if not isinstance(i, slice):
            l1[-1] = 0.0  # the intercept comes last
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, i: np.ndarray, y: int) -> None:
        i = np.append(i, len(self.z) - 1)
        x = self.weights(i)
        g = 1 / (1 + np.exp(-np.clip(x.sum(), -35, 35))) - y
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * x
        self.n[i] = n + g * g


def train(rows: DataFrame) -> list[tuple[int, float]]:
    """Weights that are not zero, from a bounded table (h, text, y) in the order of h."""

    def run(batches: Iterable[pa.RecordBatch]):
        model, seen = Ftrl(), []
        for b in batches:
            y = b.column(2).to_pylist()
            for at, texts in w.blocks(b.column(1)):
                row, f = features(texts)
                for k, part in enumerate(np.split(f[np.argsort(row, kind="stable")], np.cumsum(np.bincount(row, minlength=len(texts)))[:-1])):
                    seen.append((np.unique(part), y[at + k]))
        for _ in range(EPOCHS):
            for f, label in seen:
                model.learn(f, label)
        if seen:
            x = np.append(model.weights(slice(0, -1)), model.weights(np.array([len(model.z) - 1])))
            i = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(x[i], pa.float64())], ["i", "x"])

    one = rows.repartition(1).sortWithinPartitions("h", "y", "text")
    return [tuple(r) for r in one.mapInArrow(run, "i long, x double").collect()]


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> DataFrame:
    """At most ``limit`` labelled texts that are not held out, as (h, text, y)."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("y")).where("id is not null and y in (0, 1)").where(~held_out(F.col("id")))
    # first about as many as wanted by a hash, so that the sort that bounds them is small whatever the labels
    share = min(1.0, (1.05 * limit + 6 * limit**0.5) / max(1, known.count()))
    known = known.withColumn("h", F.xxhash64("id")).where(F.pmod("h", F.lit(1 << 40)) < int(share * (1 << 40)))
    few = known.orderBy("h", "y").limit(limit).groupBy("id", "h").agg(F.max("y").alias("y"))
    text = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return text.join(F.broadcast(few), "id").select("h", "text", "y")  # `few` has `limit` rows at most


def scores(column: pa.Array, table: np.ndarray) -> np.ndarray:
    """A score of each text, by a table of weights with the intercept last."""
    used = table != 0
    out = np.empty(len(column))
    for at, texts in w.blocks(column):
        row, f = features(texts)
        hit = used[f]
        pair = np.unique(row[hit].astype(np.int64) << BITS | f[hit])
        total = np.bincount(pair >> BITS, table[pair & ((1 << BITS) - 1)], minlength=len(texts)) + table[-1]
        out[at : at + len(texts)] = 1 / (1 + np.exp(-np.clip(total, -35, 35))) if used.any() else 0.0
    return out


def full_table(weights: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Compact weights spread over all features."""
    table = np.zeros((1 << BITS) + 1)
    table[weights[0]] = weights[1]
    return table


def compact(docs: DataFrame, weights: list[tuple[int, float]]):
    """The weights as two arrays, broadcast; at most 2**BITS + 1 pairs."""
    return docs.sparkSession.sparkContext.broadcast((np.array([i for i, _ in weights], np.int64), np.array([x for _, x in weights])))


def without_toxic(docs: DataFrame, weights: list[tuple[int, float]]) -> DataFrame:
    """The rows of ``docs``, all columns, that score under 0.5."""
    shared, text = compact(docs, weights), docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]):
        table = full_table(shared.value)
        for b in batches:
            yield b.filter(pa.array(scores(b.column(text), table) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, weights: list[tuple[int, float]]) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    shared = compact(docs, weights)

    def run(batches: Iterable[pa.RecordBatch]):
        table = full_table(shared.value)
        for b in batches:
            x = scores(b.column(2), table)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x), pa.array((x >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return cols.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, scored: DataFrame | None = None, limit: int = MAX_TRAIN) -> DataFrame:
    """Fit on the labelled rows of ``docs`` and score ``scored`` (``docs`` unless given)."""
    return score(docs if scored is None else scored, train(labelled_sample(docs, labels, limit)))


def op2_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every whole text of ``documents``."""
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
