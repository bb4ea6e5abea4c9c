"""Settings, buffers and sinks."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import functions as F
from sonarlake.functions import buffers
from sonarlake.sources import audio, settings
from sonarlake.streaming import sinks


def test_options(tmp_path):
    assert settings.Options.read(str(tmp_path / "none.json")) == settings.Options()
    (tmp_path / "o.json").write_text('{"seconds": 2.0, "other": 1}')
    assert settings.Options.read(str(tmp_path / "o.json")).seconds == 2.0


def test_gain_state():
    assert settings.Gain.load(settings.Gain(0.25).save()) == settings.Gain(0.25)
    assert settings.Gain.load(b'{"tag": "other", "level": 1}') == settings.Gain()
    assert settings.Gain.load(b"x") == settings.Gain()
    assert settings.timed(str.upper)("a")[0] == "A"


def test_buffers(spark):
    df = spark.createDataFrame([([1.0, 3.0, 5.0],), ([],)], "y array<double>")
    got = df.select(buffers.stereo(F.col("y")).alias("s"), buffers.mono(F.col("y")).alias("m"), buffers.sized(F.col("y"), 4).alias("z")).collect()
    assert got[0] == ([1, 1, 3, 3, 5, 5], [2.0], [1, 3, 5, 0]) and got[1] == ([], [], [0, 0, 0, 0])


def test_sinks(spark, tmp_path):
    pcm = bytearray((np.ones(20) * 100).astype("<i2").tobytes())
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(t, bytearray(4)), (t, pcm), (t, None)], "ts timestamp, pcm binary")
    rate, y = audio.wav_samples(sinks.first_long_sample(df, 10))
    assert rate == 48_000 and len(y) == 10
    assert sinks.first_long_sample(df, 1000) is None
    out, seen = sinks.counted(df)
    out.count()
    assert seen.get == {"all": 3, "decoded": 2}
    assert sinks.with_provenance(df, "3", "code").first().version == "3"
    spark.createDataFrame([(1, "b", "two"), (0, "a", "one")], "seq int, name string, text string").write.parquet(str(tmp_path / "in"))
    sent = []
    stream = spark.readStream.schema("seq int, name string, text string").parquet(str(tmp_path / "in"))
    q = sinks.posts(stream, sent.append).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sent == ["**a**: one", "**b**: two"]
