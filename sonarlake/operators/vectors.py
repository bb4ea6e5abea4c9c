"""Feature vectors: means, distances, libraries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of the parts that both vectors have, in doubles."""
    n = F.least(F.size(a), F.size(b))
    gaps = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2)))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x))


def means(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, mean): the mean of each place of the vectors of a key."""
    flat = df.select(F.col(key).alias("key"), F.posexplode(vector).alias("k", "v"))
    each = flat.groupBy("key", "k").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return each.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "m"))), lambda x: x["m"]).alias("mean"))


def all_pairs(library: DataFrame) -> DataFrame:
    """(a, b, d) of every ordered pair of unlike entries of a library of sounds.

    Quadratic in the library by its nature; entries are sounds or classes, not rows.
    """
    left = library.select(F.col("key").alias("a"), F.col("mean").alias("va"))
    right = library.select(F.col("key").alias("b"), F.col("mean").alias("vb"))
    return left.join(right, F.col("a") != F.col("b")).select("a", "b", distance(F.col("va"), F.col("vb")).alias("d"))


def against_one(df: DataFrame, key: str, vector: str, one: int) -> DataFrame:
    """(key, d): one entry against every other; its vector becomes a literal, so nothing is joined."""
    found = df.where(F.col(key) == one).select(vector).first()
    rest = df.where(F.col(key) != one)
    if found is None:
        return rest.limit(0).select(F.col(key), F.lit(0.0).alias("d"))
    single = F.array(*(F.lit(float(v)) for v in found[0]))
    return rest.select(F.col(key), distance(F.col(vector), single).alias("d"))


def distance_maps(pairs: DataFrame) -> DataFrame:
    """(a, distances, mean): each entry's distances as a map, and their mean."""
    made = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("b").cast("string").alias("k"), F.round("d", 6).alias("v")))))
    return pairs.groupBy("a").agg(made.alias("distances"), F.avg("d").alias("mean"))
