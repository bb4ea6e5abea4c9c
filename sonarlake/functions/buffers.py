"""Expressions over arrays of samples as buffers of channels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stereo(mono: Column) -> Column:
    """Interleaved two channels of the same samples."""
    return F.flatten(F.transform(mono, lambda v: F.array(v, v)))


def mono(interleaved: Column, channels: int = 2) -> Column:
    """Mean of the channels of interleaved samples; a last frame that is not whole is dropped."""
    frames = F.floor(F.size(interleaved) / channels).cast("int")
    at = F.when(frames > 0, F.sequence(F.lit(0), frames - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: sum((F.get(interleaved, i * channels + k).cast("double") for k in range(channels)), F.lit(0.0)) / channels)


def sized(y: Column, n: int) -> Column:
    """Exactly n samples: cut, or padded with zeros."""
    return F.slice(F.concat(y.cast("array<double>"), F.array_repeat(F.lit(0.0), n)), 1, n)


def cleared(channels: Column, inputs: int) -> Column:
    """Channels from ``inputs`` on are silent; each keeps its length."""
    return F.transform(channels, lambda c, i: F.when(i < inputs, c).otherwise(F.transform(c, lambda _: F.lit(0.0))))


def preview(y: Column, n: int = 5) -> Column:
    """The first n values."""
    return F.slice(y, 1, n)
