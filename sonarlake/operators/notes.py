"""Note events to sound: pairing, rendering, mixing."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import signal

EVENTS = [("note_on", 60, 100, 0.0), ("note_off", 60, 0, 0.5), ("note_on", 64, 100, 0.5), ("note_off", 64, 0, 1.0), ("note_on", 67, 100, 1.0), ("note_off", 67, 0, 1.5), ("note_on", 72, 120, 1.5), ("note_off", 72, 0, 3.0)]
SECONDS, RATE = 5.0, 44_100
#: attack, decay, sustain, release and loudness by version; version 3 has a second envelope for its filter
VOICES = {1: (0.05, 0.2, 0.6, 0.3, 0.2), 2: (0.02, 0.1, 0.4, 0.15, 0.15), 3: (0.01, 0.1, 0.4, 0.2, 0.15)}
FILTER = (0.05, 0.2, 0.1, 0.2)
CUTOFF, SWEEP, BLOCK = 100.0, 3000.0, 128
NOISE = 0.05


def events(spark: SparkSession) -> DataFrame:
    """The default sequence of eight events."""
    return spark.createDataFrame([(i, *e) for i, e in enumerate(EVENTS)], "seq int, type string, note int, velocity int, time double")


def pairs(midi: DataFrame, seconds: float = SECONDS, rate: int = RATE) -> DataFrame:
    """(note, velocity, start, stop): a release ends the latest strike of its note.

    A second strike replaces the first; releases without strike and strikes
    without release give nothing; events from the end on are ignored.
    """
    total = int(seconds * rate)
    on = (F.col("type") == "note_on") & (F.col("velocity") > 0)
    used = midi.where(F.floor(F.col("time") * rate) < total).where(F.col("type").isin("note_on", "note_off"))
    w = Window.partitionBy("note").orderBy("seq")
    before = used.select("note", "seq", "time", on.alias("is_on"), F.lag(on).over(w).alias("was_on"), F.lag("time").over(w).alias("start"), F.lag("velocity").over(w).alias("velocity"))
    return before.where("not is_on and was_on").select("seq", "note", "velocity", "start", F.col("time").alias("stop"))


def spans(paired: DataFrame, version: int, seconds: float = SECONDS, rate: int = RATE) -> DataFrame:
    """Paired notes with first and end sample, pitch and loudness."""
    release, loud = VOICES[version][3:]
    if version == 3:
        release = max(release, FILTER[3])
    first = F.floor(F.col("start") * rate).cast("long")
    size = F.floor((F.col("stop") - F.col("start") + release) * rate).cast("long")
    out = paired.withColumns({"first": first, "hz": signal.note_hz(F.col("note")), "loud": F.col("velocity") / F.lit(127.0) * loud})
    out = out.withColumn("n", F.least(F.col("first") + size, F.lit(int(seconds * rate))) - F.col("first"))
    return out.where("n > 0")


def _tone(version: int, hz: Column, t: Column) -> Column:
    turn = hz * t * (2 * np.pi)
    if version == 1:
        return F.sin(turn) + 0.4 * F.sin(turn * 2) + 0.2 * F.sin(turn * 3) + 0.1 * F.sin(turn * 4)
    return F.sin(turn + 5.0 * F.sin(turn * 3.5))


def mixed(notes: DataFrame, version: int, rate: int = RATE, noise_seed: int | None = None) -> DataFrame:
    """(idx, y): notes of version 1 or 2 rendered by expressions and added up where they overlap.

    Samples of a note are made where the note is; overlapping ones meet in one
    partially aggregated sum. ``noise_seed`` adds version 2's breath.
    """
    attack, decay, sustain, release, _ = VOICES[version]
    each = notes.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    t = F.col("k") / F.lit(float(rate))
    whole = [F.lit(int(v * rate)).cast("long") for v in (attack, decay, release)]
    env = signal.adsr_at(F.col("k"), F.col("n"), whole[0], whole[1], sustain, whole[2])
    tone = _tone(version, F.col("hz"), t)
    if noise_seed is not None and version == 2:
        w = Window.partitionBy("seq").orderBy("k")
        # a normal variate of the sample's own place, so that a seed fixes the sound however rows are spread
        unit = lambda j: (F.shiftrightunsigned(F.xxhash64(F.lit(noise_seed), "seq", "k", F.lit(j)), 11) + 1) / F.lit(float(1 << 53))
        each = each.withColumn("white", F.sqrt(-2 * F.log(unit(0))) * F.cos(2 * math.pi * unit(1)) * NOISE)
        each = each.withColumn("breath", F.col("white") - F.coalesce(F.lag("white").over(w), F.lit(0.0)))
        tone = tone + F.col("breath")
    summed = each.select((F.col("first") + F.col("k")).alias("idx"), (tone * env * F.col("loud")).alias("y")).groupBy("idx").agg(F.sum("y").alias("y"))
    level = F.greatest(F.least(F.col("y"), F.lit(1.0)), F.lit(-1.0)) if version == 1 else F.tanh("y")
    return summed.select("idx", level.alias("y"))


def swept_note(hz: float, first: int, n: int, loud: float, rate: int) -> np.ndarray:
    """A note of version 3: a sawtooth through a low-pass that an envelope sweeps, block by block."""
    t = np.arange(n) / rate
    x = hz * (t + first / rate)
    saw = 2 * (x - np.floor(x)) - 1
    a, d, s, r, _ = VOICES[3]
    fa, fd, fs, fr = FILTER
    sweep = signal.adsr(n, int(fa * rate), int(fd * rate), fs, int(fr * rate))
    out, state = np.empty(n), np.zeros(2)
    for k in range(0, n, BLOCK):
        cutoff = min(max(CUTOFF + SWEEP * sweep[k : k + BLOCK].mean(), 20.0), 0.45 * rate)
        out[k : k + BLOCK], state = signal.biquad(saw[k : k + BLOCK], *signal.lowpass(cutoff, rate), state)
    return out * signal.adsr(n, int(a * rate), int(d * rate), s, int(r * rate)) * loud


def swept(notes: DataFrame, rate: int = RATE) -> DataFrame:
    """(idx, y) of version 3; the filter's state runs through each note, so notes are the unit of work."""

    def run(batches):
        for b in batches:
            for seq, hz, first, n, loud in zip(*(b.column(k).to_pylist() for k in range(5))):
                y = swept_note(hz, first, n, loud, rate)
                yield pa.RecordBatch.from_arrays([pa.array(first + np.arange(n)), pa.array(y)], ["idx", "y"])

    parts = notes.select("seq", "hz", "first", "n", "loud").mapInArrow(run, "idx long, y double")
    return parts.groupBy("idx").agg(F.sum("y").alias("y")).select("idx", F.tanh("y").alias("y"))


def render(midi: DataFrame, version: int, seconds: float = SECONDS, rate: int = RATE, noise_seed: int | None = None) -> DataFrame:
    """(idx, y) of a whole sequence by one of three voices; samples without a note are absent (zero)."""
    if version not in VOICES:
        raise ValueError(f"no voice {version}")
    notes = spans(pairs(midi, seconds, rate), version, seconds, rate)
    return swept(notes, rate) if version == 3 else mixed(notes, version, rate, noise_seed)
