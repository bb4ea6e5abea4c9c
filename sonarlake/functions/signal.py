"""Expressions and kernels over samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

VOICE_RATE = 48_000
BYTES_PER_SECOND = VOICE_RATE * 2 * 2


def to_int16(x: Column) -> Column:
    """Full-scale float to 16-bit, truncated; out of range is clipped rather than wrapped."""
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0)).__mul__(32767).cast("int")


def to_float(x: Column) -> Column:
    """16-bit to float; the scale differs from the way there."""
    return x / F.lit(32768.0)


def decimate(y: Column, step: int = 3) -> Column:
    """Every ``step``-th sample, without a filter."""
    return F.filter(y, lambda _, i: i % step == 0)


def pcm_seconds(pcm: Column) -> Column:
    """Length of an interleaved 16-bit stereo buffer."""
    return F.length(pcm) / F.lit(float(BYTES_PER_SECOND))


def note_hz(note: Column) -> Column:
    """Equal temperament around A4."""
    return F.pow(F.lit(2.0), (note - 69) / F.lit(12.0)) * 440.0


def gain(y: Column, level: float) -> Column:
    """All samples times a level."""
    return F.transform(y, lambda v: v.cast("double") * level)


def layout_ok(inputs: Column, outputs: Column) -> Column:
    """Mono or stereo, and as many channels out as in."""
    return outputs.isin(1, 2) & (inputs == outputs)


def adsr(n: int, attack: int, decay: int, sustain: float, release: int) -> np.ndarray:
    """Piecewise linear envelope whose ramps include both their ends.

    Ramps longer than the note are shortened in proportion and the hold dropped;
    the result may then be shorter than ``n`` and is padded with zeros.
    """
    ramps = attack + decay + release
    if ramps > n:
        attack, decay, release = (int(k * (n / ramps)) for k in (attack, decay, release))
        hold = 0
    else:
        hold = n - ramps
    env = np.concatenate([np.linspace(0, 1, attack), np.linspace(1, sustain, decay), np.full(hold, sustain), np.linspace(sustain, 0, release)])
    return np.pad(env, (0, max(0, n - len(env))))[:n]


def adsr_at(k: Column, n: Column, attack: Column, decay: Column, sustain: float, release: Column) -> Column:
    """The same envelope at sample k, as an expression."""
    ramps = attack + decay + release
    ratio = n / ramps.cast("double")
    over = ramps > n
    a, d, r = (F.when(over, F.floor(v * ratio)).otherwise(v).cast("long") for v in (attack, decay, release))
    hold = F.when(over, F.lit(0)).otherwise(n - ramps).cast("long")

    def ramp(at: Column, size: Column, start: float, stop: float) -> Column:
        return F.when(size > 1, F.lit(start) + (F.lit(stop) - F.lit(start)) * at / F.when(size > 1, size - 1)).otherwise(F.lit(start))

    return (
        F.when(k < a, ramp(k, a, 0.0, 1.0))
        .when(k < a + d, ramp(k - a, d, 1.0, sustain))
        .when(k < a + d + hold, F.lit(sustain))
        .when(k < a + d + hold + r, ramp(k - a - d - hold, r, sustain, 0.0))
        .otherwise(F.lit(0.0))
    )


def lowpass(cutoff: float, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Second-order Butterworth low-pass by the bilinear transform: (b, a)."""
    k = np.tan(np.pi * cutoff / rate)
    norm = 1 / (1 + np.sqrt(2) * k + k * k)
    b0 = k * k * norm
    return np.array([b0, 2 * b0, b0]), np.array([1.0, 2 * (k * k - 1) * norm, (1 - np.sqrt(2) * k + k * k) * norm])


def biquad(x: np.ndarray, b: np.ndarray, a: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filter a block in transposed direct form, carrying the state."""
    y = np.empty(len(x))
    z0, z1 = state
    for i, v in enumerate(x):
        out = b[0] * v + z0
        z0 = b[1] * v - a[1] * out + z1
        z1 = b[2] * v - a[2] * out
        y[i] = out
    return y, np.array([z0, z1])
