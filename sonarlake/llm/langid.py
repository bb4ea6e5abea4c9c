"""Language identification by error-correcting output codes.

Each language gets a codeword; one logistic classifier over hashed byte n-grams
(orders 1 to 3 of the lower-cased letters) predicts each bit. Loss-weighted
decoding adds up, for every codeword, the logistic loss of the bits' margins,
weighted by how reliable each bit was in training, and takes the least. A small
gap to the second best flags ambiguity.

Fitted on at most ``MAX_TRAIN`` rows with a language, about as many of each;
every whole text is predicted.

Defined results: a null text or one without a letter is ``und`` with score 0; so
is every text if no row has a language; a lone language is always predicted; of
equally near codewords the language first in order is taken; a null id counts as
the empty text in the split; repeated rows are learned from and predicted as often
as they come; extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as w
from .toxicity import held_out

SIZE = 8192
MAX_TRAIN = 4000
STEPS = 120
AMBIGUOUS = 0.2
MOST_LANGS = 100_000  # rows of two columns that are broadcast; more are joined by a shuffle

_LETTER = np.full(256, 32, np.uint8)
for _b in [*range(65, 91), *range(97, 123), *range(128, 256)]:
    _LETTER[_b] = _b
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def code_matrix(n: int) -> np.ndarray:
    """Codewords (rows of -1 and 1): exhaustive to 5 classes, else the best of random ones."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        bits = np.arange(1 << (n - 1))[1:] if n > 2 else np.array([1])
        rows = np.array([[1 if c == 0 else (1 if (b >> (c - 1)) & 1 == 0 else -1) for b in bits] for c in range(n)])
        return rows.astype(float)
    rng = np.random.default_rng(7)
    width = int(np.ceil(10 * np.log2(n)))
    best, gap = None, -1
    for _ in range(200):
        m = rng.choice([-1.0, 1.0], (n, width))
        d = (width - m @ m.T) / 2
        least = d[~np.eye(n, dtype=bool)].min()
        if least > gap and (np.abs(m.sum(0)) < n).all():
            best, gap = m, least
    return best


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit-length root n-gram counts of at most 256 texts, and which have a letter."""
    low = pc.utf8_lower(texts)
    off, raw = w.buffers(low)
    lo, hi = int(off[0]), int(off[-1])
    data, edge, rows = raw[lo:hi], (off - lo).astype(np.int64), len(texts)
    x = np.zeros((rows, SIZE), np.float32)
    some = np.zeros(rows, bool)
    if not len(data):
        return x, some
    row = np.repeat(np.arange(rows), np.diff(edge))
    some |= np.bincount(row[_ASCII_LETTER[data]], minlength=rows) > 0
    for r in np.flatnonzero(~some & (np.diff(edge) > 0)):
        some[r] = any(c.isalpha() for c in texts[int(r)].as_py())
    b = _LETTER[data].astype(np.uint32)
    keys = [row * SIZE + (b * np.uint32(2654435761) >> np.uint32(19))]
    if len(b) > 2:
        two = b[:-1] << np.uint32(8) | b[1:]
        for g, mult in ((two, 2246822519), (two[:-1] << np.uint32(8) | b[2:], 3266489917)):
            k = len(b) - len(g)
            same = (row[k:] == row[:-k]) & ((g & np.uint32(0xFFFF)) != np.uint32(0x2020))
            keys.append(row[k:][same] * SIZE + ((g * np.uint32(mult)) >> np.uint32(19))[same])
    counts = np.bincount(np.concatenate(keys), minlength=rows * SIZE).reshape(rows, SIZE)
    np.sqrt(counts, out=x, casting="unsafe")
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return x, some


def slices(column: pa.Array):
    """(first row, texts): blocks of bounded bytes and at most 256 rows."""
    for at, texts in w.blocks(column):
        for k in range(0, len(texts), 256):
            yield at + k, texts.slice(k, 256)


def fit(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codewords, weights, intercepts, reliability of bits) by accelerated gradient steps."""
    code = code_matrix(n)
    t = code[y]
    wt, bias = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    look, look_b, rate, lam = wt.copy(), bias.copy(), 6.0, 1e-4
    for k in range(STEPS):
        g = -t / (1 + np.exp(np.clip(t * (x @ look + look_b), -30, 30))) / max(1, len(x))
        new, new_b = look - rate * (x.T @ g.astype(np.float32) + lam * look), look_b - rate * g.sum(0).astype(np.float32)
        look, look_b = new + k / (k + 3) * (new - wt), new_b + k / (k + 3) * (new_b - bias)
        wt, bias = new, new_b
    right = ((x @ wt + bias) * t > 0).mean(0) if len(x) else np.ones(code.shape[1])
    return code, wt, bias, np.maximum(right - 0.5, 0.01) * 2


def sample(docs: DataFrame, limit: int = MAX_TRAIN) -> DataFrame:
    """At most ``limit`` rows (h, text, lang), about as many of each language."""
    known = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null").where(~held_out(F.col("doc_id")))
    counts = known.groupBy("lang").count()
    langs = counts.count()
    share = counts.select("lang", (F.lit(limit / max(1, langs)) / F.col("count")).alias("p"))  # a row a language
    share = F.broadcast(share) if langs <= MOST_LANGS else share
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    return known.join(share, "lang").where(unit < F.col("p")).select(F.xxhash64("doc_id").alias("h"), "text", "lang").limit(limit + limit // 4)


def train(rows: DataFrame) -> dict | None:
    """The model from a bounded table (h, text, lang), fitted in one task."""

    def run(batches: Iterable[pa.RecordBatch]):
        xs, ys = [], []
        for b in batches:
            y = b.column(2).to_pylist()
            for at, texts in slices(b.column(1)):
                x, some = features(texts)
                xs.append(x[some])
                ys += [y[at + k] for k in np.flatnonzero(some)]
        if ys:
            langs = sorted(set(ys))
            code, wt, bias, rely = fit(np.concatenate(xs), np.array([langs.index(v) for v in ys]), len(langs))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps({"langs": langs, "code": code, "w": wt, "b": bias, "rely": rely})], pa.binary())], ["model"])

    got = rows.repartition(1).sortWithinPartitions("h", "lang", "text").mapInArrow(run, "model binary").collect()
    return pickle.loads(bytes(got[0].model)) if got else None  # noqa: S301


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous, second) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SIZE x bits floats

    def run(batches: Iterable[pa.RecordBatch]):
        m = shared.value
        for b in batches:
            pred, score, second = np.full(b.num_rows, "und", object), np.zeros(b.num_rows), np.full(b.num_rows, None, object)
            for at, texts in slices(b.column(2)) if m else ():
                x, some = features(texts)
                margin = x @ m["w"] + m["b"]
                loss = np.stack([np.logaddexp(0, -margin * c) @ m["rely"] for c in m["code"]], axis=1) / m["rely"].sum()
                p = np.exp(4 * (loss.min(1, keepdims=True) - loss))
                p /= p.sum(1, keepdims=True)
                order = np.argsort(loss, axis=1, kind="stable")
                for k in np.flatnonzero(some):
                    pred[at + k], score[at + k] = m["langs"][order[k, 0]], p[k, order[k, 0]]
                    if len(m["langs"]) > 1 and p[k, order[k, 0]] - p[k, order[k, 1]] < AMBIGUOUS:
                        second[at + k] = m["langs"][order[k, 1]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pred, pa.string()), pa.array(score), pa.array([s is not None for s in second], pa.bool_()), pa.array(second, pa.string())], ["doc_id", "held_out", "lang_pred", "score", "ambiguous", "second"])

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return cols.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean, second string")


def op8_ecoc_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, train(sample(docs)))
