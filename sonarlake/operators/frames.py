"""Envelopes, peaks and self-similarity over frame tables (key, i, x)."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROMINENCE = 0.5


def envelope(df: DataFrame, key: str, at: str, value: str, width: int) -> DataFrame:
    """Sum of values per key and frame of ``width`` seconds, numbered without gaps.

    Values are summed before the numbering, so the window sees frames, not rows.
    """
    frame = F.floor(F.unix_timestamp(F.col(at).cast("timestamp")) / width).cast("long")
    sums = df.groupBy(F.col(key).alias("key"), frame.alias("frame")).agg(F.sum(value).alias("x"))
    order = Window.partitionBy("key").orderBy("frame")
    return sums.select("key", (F.row_number().over(order) - 1).cast("long").alias("i"), (F.col("frame") * width).alias("t"), F.round("x", 6).alias("x"))


def scalars(frames: DataFrame) -> DataFrame:
    """Per key: the maximum, the greatest distance of two frames (max less min) and the count."""
    return frames.groupBy("key").agg(F.max("x").alias("max_x"), (F.max("x") - F.min("x")).alias("max_dist"), F.count("*").alias("n"))


def guard(c: Column) -> Column:
    """The value, or 1 where it is not positive."""
    return F.when(c > 0, c).otherwise(F.lit(1.0))


def normalize(frames: DataFrame) -> DataFrame:
    """Each frame over its key's maximum."""
    return frames.join(scalars(frames).select("key", "max_x"), "key").select("key", "i", (F.col("x") / guard(F.col("max_x"))).alias("x_norm"))


def prominences(x: np.ndarray, least: float = PROMINENCE) -> list[tuple[int, float]]:
    """(index, prominence) of local maxima; a plateau counts at its middle, ends never.

    Walls on each side come from a stack of falling heights, in linear time.
    """
    n = len(x)
    if n < 3:
        return []
    heads = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    tails = np.append(heads[1:], n) - 1
    v = x[heads]
    m = len(v)

    def bases(v: np.ndarray) -> np.ndarray:
        out, stack = np.empty(len(v)), []  # (height, least since)
        for k, h in enumerate(v):
            low = h
            while stack and stack[-1][0] <= h:
                low = min(low, stack.pop()[1])
            out[k] = low
            stack.append((h, low))
        return out

    left, right = bases(v), bases(v[::-1])[::-1]
    found = []
    for k in range(1, m - 1):
        if v[k] > v[k - 1] and v[k] > v[k + 1]:
            height = v[k] - max(left[k], right[k])
            if height >= least:
                found.append((int((heads[k] + tails[k]) // 2), float(height)))
    return found


def peaks(frames: DataFrame, least: float = PROMINENCE) -> DataFrame:
    """(key, i, x, prominence) of local maxima that stand out; one group is one recording."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("i")
        x = t["x"].to_numpy()
        found = prominences(x, least)
        at = [k for k, _ in found]
        return pa.table({"key": t["key"].take(pa.array(at, pa.int64())), "i": t["i"].take(pa.array(at, pa.int64())), "x": t["x"].take(pa.array(at, pa.int64())), "prominence": pa.array([p for _, p in found], pa.float64())})

    return frames.select("key", "i", "x").groupBy("key").applyInArrow(run, "key string, i long, x double, prominence double")


def similarity_pairs(frames: DataFrame) -> DataFrame:
    """(key, i, j, s) for i < j: similarity of levels times the lower relative level.

    Quadratic in the frames of a recording by its nature; ask for one recording,
    or for :func:`most_similar`, which is not.
    """
    s = scalars(frames)
    a = frames.select("key", "i", F.col("x").alias("xi"))
    b = frames.select("key", F.col("i").alias("j"), F.col("x").alias("xj"))
    pairs = a.join(b, "key").where("i < j").join(s, "key")
    return pairs.select("key", "i", "j", weighted(F.col("xi"), F.col("xj")).alias("s"))


def weighted(xi: Column, xj: Column) -> Column:
    """(1 - |xi - xj| / max_dist) * min(xi, xj) / max_x, with zero guards."""
    return (1 - F.abs(xi - xj) / guard(F.col("max_dist"))) * F.least(xi / guard(F.col("max_x")), xj / guard(F.col("max_x")))


def most_similar(frames: DataFrame) -> DataFrame:
    """Per key the most similar pair of frames, with levels and scalars.

    For xi <= xj the similarity falls as xj grows, so the best partner is the next
    value in sorted order: one sort instead of all pairs. All-zero recordings give
    frames 0 and 1, a single frame gives itself.
    """
    order = Window.partitionBy("key").orderBy("x", "i")
    near = frames.select("key", "i", "x", F.lead("i").over(order).alias("j"), F.lead("x").over(order).alias("xj"))
    both = near.where("j is not null").join(scalars(frames), "key")
    both = both.select("key", "max_x", "max_dist", "n", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.when(F.col("i") < F.col("j"), F.col("x")).otherwise(F.col("xj")).alias("xi"), F.when(F.col("i") < F.col("j"), F.col("xj")).otherwise(F.col("x")).alias("xj"))
    scored = both.withColumn("s", weighted(F.col("xi"), F.col("xj")))
    best = scored.groupBy("key").agg(F.max_by(F.struct("i", "j", "xi", "xj", "s", "max_dist", "max_x"), F.struct(F.round("s", 12).alias("s"), (-F.col("i")).alias("i"), (-F.col("j")).alias("j"))).alias("b"))
    lone = scalars(frames).where("n = 1").select("key", F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.col("max_x").alias("xi"), F.col("max_x").alias("xj"), F.when(F.col("max_x") > 0, 1.0).otherwise(0.0).alias("s"), "max_dist", "max_x").alias("b"))
    zero = F.struct(F.lit(0).cast("long").alias("i"), F.lit(1).cast("long").alias("j"))
    best = best.select("key", F.when(F.col("b.s") > 0, F.col("b")).otherwise(F.col("b").withField("i", zero["i"]).withField("j", zero["j"])).alias("b"))
    return best.unionByName(lone).select("key", "b.*")


def rms_by(df: DataFrame, keys: Iterable[str], value: Column) -> DataFrame:
    """Root mean square per group."""
    return df.groupBy(*keys).agg(F.sqrt(F.avg(value * value)).alias("rms"), F.count("*").alias("n"))


def louder_than(df: DataFrame, level: float = 100.0) -> DataFrame:
    """Groups that are not silence."""
    return df.where(F.col("rms") >= level)


def sign_changes(df: DataFrame, key: str, order: list[str], value: Column) -> DataFrame:
    """Share of neighbours whose signs differ."""
    w = Window.partitionBy(key).orderBy(*order)
    negative = (value < 0).cast("int")
    flips = df.select(key, (negative != F.lag(negative).over(w)).cast("int").alias("flip"))
    return flips.groupBy(key).agg((F.coalesce(F.sum("flip"), F.lit(0)) / F.count("*")).alias("zcr"))


def first_difference(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Each value less the one before it, the first less 0."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("diff", F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0.0)))
