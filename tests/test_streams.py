"""Streams against the batch operators they share folds with."""

from __future__ import annotations

import datetime as dt

import numpy as np
from sonarlake.streaming import speech


def run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert not q.exception()


def test_utterances(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [("a", base + dt.timedelta(seconds=s), i, x) for i, (s, x) in enumerate([(0, 0.5), (0.5, 0.8), (5, 0.4), (100, 0.1)])]
    rows += [("b", base + dt.timedelta(seconds=k), 10 + k, 2.0) for k in range(8)]
    spark.createDataFrame(rows, "key string, ts timestamp, id long, seconds double").coalesce(1).write.parquet(str(tmp_path / "in"))
    chunks = spark.readStream.schema("key string, ts timestamp, id long, seconds double").parquet(str(tmp_path / "in"))
    run(speech.utterances(chunks), "utter")
    got = sorted((r.key, r.seconds) for r in spark.table("utter").collect())
    assert ("a", 1.3) in got
    assert [x for k, x in got if k == "b"].count(2.0) >= 1


def test_summaries(spark, tmp_path):
    rows = [("c", 0, "one two three"), ("c", 1, "four five"), ("c", 2, "six"), ("d", 0, "alone")]
    spark.createDataFrame(rows, "key string, seq long, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    texts = spark.readStream.schema("key string, seq long, text string").parquet(str(tmp_path / "in"))
    run(speech.summaries(texts, lambda s: (s.upper(), "calm"), most=5), "sums")
    got = [tuple(r) for r in spark.table("sums").collect()]
    assert got == [("c", "ONE TWO THREE\nFOUR FIVE", 5, 2)]


def test_silence_goes_before_the_model(spark):
    loud = (np.ones(100) * 1000).astype("<i2").tobytes()
    df = spark.createDataFrame([("x", bytearray(loud)), ("y", bytearray(200))], "speaker string, pcm binary")
    out = speech.transcribed(speech.audible(df), lambda b: str(len(b))).collect()
    assert [(r.speaker, r.text, r.error) for r in out] == [("x", "200", None)]

    def broken(_):
        raise RuntimeError("no model")

    assert speech.transcribed(df, broken).where("error is null").count() == 0


def test_running_statistics_equal_those_of_the_whole_text(spark, tmp_path):
    from pyspark.sql import functions as F
    from sonarlake.functions import text as tx

    rows = [("a", 0, "Hi ... there, don't!"), ("a", 1, "this goes"), ("b", 2, "One. Two three"), ("a", 3, "on. and on? yes"), ("b", 4, "four!"), ("c", 5, "...")]
    for k, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, "key string, seq long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    texts = spark.readStream.schema("key string, seq long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = speech.running_stats(texts).writeStream.format("memory").queryName("stats").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert not q.exception()
    got = {}
    for r in spark.table("stats").collect():
        if r.key not in got or r.word_count >= got[r.key].word_count:
            got[r.key] = r
    assert set(got) == {"a", "b", "c"}
    whole = spark.createDataFrame([(k, " ".join(t for key, _, t in rows if key == k)) for k in "abc"], "key string, s string")
    for r in whole.select("key", *tx.text_stats(F.col("s"))).collect():
        assert tuple(got[r.key]) == tuple(r), r.key
    assert got["a"].word_count == 9 and got["a"].max_words_per_sentence == 3  # "this goes on", over two batches
