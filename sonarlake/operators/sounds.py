"""From recordings and renderings to features, reports and a library of sounds."""

from __future__ import annotations

import json
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spectral
from . import frames as fr
from . import notes

FEATURES = "average_rms double, peak_rms double, average_spectral_centroid double, average_spectral_bandwidth double, average_spectral_flatness double, average_zero_crossing_rate double, estimated_tempo double, mfcc_means array<double>, frames long"


def features(waves: DataFrame) -> DataFrame:
    """Features of each (key, rate, y) waveform; one sound is the unit of work."""
    names = [p.split()[0] for p in FEATURES.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            keys, rates, ys = (b.column(k).to_pylist() for k in range(3))
            got = [spectral.sound_features(np.array(y, float), r) for r, y in zip(rates, ys)]
            kinds = [pa.list_(pa.float64()) if n == "mfcc_means" else pa.int64() if n == "frames" else pa.float64() for n in names]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g[n] for g in got], k) for n, k in zip(names, kinds))], ["key", *names])

    return waves.select(F.col("key").cast("string").alias("key"), "rate", "y").mapInArrow(run, "key string, " + FEATURES)


def onset_frames(waves: DataFrame, hop_seconds: float = 0.1) -> DataFrame:
    """(key, i, x): the onset envelope of each waveform."""

    def run(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            for key, rate, y in zip(*(b.column(k).to_pylist() for k in range(3))):
                x = spectral.onset_strength(np.array(y, float), rate, max(1, int(rate * hop_seconds)))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(x), pa.string()), pa.array(np.arange(len(x))), pa.array(x)], ["key", "i", "x"])

    return waves.select(F.col("key").cast("string").alias("key"), "rate", "y").mapInArrow(run, "key string, i long, x double")


def waveform(samples: DataFrame, key: str, seconds: float, rate: int) -> DataFrame:
    """(key, rate, y) from (idx, y) samples of one rendering, with zeros where none is."""
    n = int(seconds * rate)
    every = samples.sparkSession.range(n).withColumnRenamed("id", "idx")
    full = every.join(samples, "idx", "left").select("idx", F.coalesce("y", F.lit(0.0)).alias("y"))
    return full.agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "y"))), lambda s: s["y"]).alias("y")).select(F.lit(key).alias("key"), F.lit(rate).alias("rate"), "y")


def library(spark: SparkSession, seconds: float = notes.SECONDS, rate: int = notes.RATE) -> DataFrame:
    """Features of the default sequence in every voice."""
    midi = notes.events(spark)
    parts = [waveform(notes.render(midi, v, seconds, rate, noise_seed=1), str(v), seconds, rate) for v in sorted(notes.VOICES)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return features(out)


def report_rows(frames: DataFrame) -> DataFrame:
    """(key, report): per recording a JSON of its envelope, peaks and most similar pair."""
    env = frames.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("i", F.round("x", 6).alias("x")))).alias("envelope"))
    peak = fr.peaks(frames).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("i", F.round("x", 6).alias("x")))).alias("peaks"))
    top = fr.most_similar(frames).select("key", F.struct("i", "j", F.round("s", 6).alias("s"), "max_dist", "max_x").alias("peak_similarity"))
    return env.join(peak, "key", "left").join(top, "key", "left").select("key", F.to_json(F.struct("envelope", "peaks", "peak_similarity")).alias("report"))


def binned_matrix(frames: DataFrame, bins: int = 64) -> DataFrame:
    """(key, bi, bj, s): the similarity matrix averaged over a fixed grid, not its N squared cells."""
    pairs = fr.similarity_pairs(frames)
    n = fr.scalars(frames).select("key", "n")
    placed = pairs.join(n, "key").select("key", F.floor(F.col("i") * bins / F.col("n")).alias("bi"), F.floor(F.col("j") * bins / F.col("n")).alias("bj"), "s")
    return placed.groupBy("key", "bi", "bj").agg(F.avg("s").alias("s"))


PAGE = """<!doctype html><meta charset="utf-8"><title>Transients</title>
<label>Recording <select id="pick"></select></label><canvas id="plot" width="900" height="240"></canvas><pre id="note"></pre>
<script>
const data = @DATA@;
const pick = document.getElementById("pick"), plot = document.getElementById("plot"), note = document.getElementById("note");
for (const name of Object.keys(data).sort()) pick.add(new Option(name));
function show() {
  const d = data[pick.value], g = plot.getContext("2d"), top = Math.max(1e-9, ...d.envelope.map(p => p.x));
  g.clearRect(0, 0, plot.width, plot.height); g.beginPath();
  d.envelope.forEach((p, k) => g.lineTo(k * plot.width / d.envelope.length, plot.height * (1 - p.x / top)));
  g.stroke(); note.textContent = JSON.stringify(d.peak_similarity, null, 1);
}
pick.onchange = show; if (pick.options.length) show();
</script>
"""


def html_report(reports: DataFrame) -> str:
    """A page of all reports, streamed to the driver row by row; ``</`` is escaped."""
    data = {r.key: json.loads(r.report) for r in reports.toLocalIterator()}
    return PAGE.replace("@DATA@", json.dumps(data).replace("</", "<\\/"))
