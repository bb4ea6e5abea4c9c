"""Operators against plain Python."""

from __future__ import annotations

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sonarlake.functions import signal, spectral
from sonarlake.functions import text as tx
from sonarlake.operators import frames as fr
from sonarlake.operators import notes, sounds
from sonarlake.operators import sessions as ss
from sonarlake.operators import vectors as vec
from sonarlake.sources import audio


def plain_stats(s: str) -> tuple:
    words, ends, current = [], [], 0
    for part in re.split(r"([.!?])", re.sub(r"[^\w\s.!?]", "", s)):
        if part in (".", "!", "?"):
            if current:
                ends.append(current)
            current = 0
        else:
            for x in part.split():
                words.append(len(x))
                current += 1
    mean = lambda v: round(sum(v) / len(v), 6) if v else 0.0
    return (len(words), mean(words), min(words, default=0), max(words, default=0), mean(ends), min(ends, default=0), max(ends, default=0))


def test_text_stats(spark):
    texts = ["don't stop. 3.14!", "... ! ?", "", "été à Paris. Où?", "no end", "a b c.", "One. two three! four"]
    df = spark.createDataFrame([(t,) for t in texts], "s string").select("s", *tx.text_stats(tx.F.col("s")))
    for row in df.collect():
        assert tuple(row)[1:] == plain_stats(row.s), row.s


def slow_prominences(x):
    out = []
    n, k = len(x), 1
    while k < n - 1:
        if x[k] > x[k - 1]:
            e = k
            while e + 1 < n and x[e + 1] == x[k]:
                e += 1
            if e + 1 < n and x[e + 1] < x[k]:
                p = (k + e) // 2
                lo = next((i for i in range(p, -1, -1) if x[i] > x[p]), 0)
                hi = next((i for i in range(p, n) if x[i] > x[p]), n - 1)
                h = x[p] - max(min(x[lo : p + 1]), min(x[p : hi + 1]))
                if h >= 0.5:
                    out.append((p, float(h)))
            k = e
        k += 1
    return out


@given(st.lists(st.integers(0, 6), max_size=30))
@settings(max_examples=300, deadline=None)
def test_prominences(values):
    x = np.array(values, float)
    assert fr.prominences(x) == slow_prominences(x)


def dense_top(x):
    x = np.asarray(x, float)
    if len(x) == 1:
        return 0, 0
    mx, d = x.max() or 1.0, np.abs(x[:, None] - x[None])
    s = (1 - d / (d.max() or 1.0)) * np.minimum(x[:, None] / mx, x[None] / mx)
    np.fill_diagonal(s, -1)
    return divmod(int(np.argmax(np.round(s, 12))), len(x))


def test_most_similar(spark):
    rng = np.random.default_rng(1)
    cases = {"zero": [0.0, 0, 0], "one": [3.0], "same": [2.0, 2, 2]} | {f"r{k}": rng.integers(0, 8, rng.integers(2, 20)).astype(float).tolist() for k in range(20)}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in cases.items() for i, v in enumerate(x)], "key string, i long, x double")
    got = {r.key: (r.i, r.j) for r in fr.most_similar(df).collect()}
    assert got == {k: dense_top(x) for k, x in cases.items()}


@given(st.integers(0, 60), st.integers(0, 20), st.integers(0, 20), st.integers(0, 20))
@settings(max_examples=100, deadline=None)
def test_adsr_shape(n, a, d, r):
    env = signal.adsr(n, a, d, 0.5, r)
    assert len(env) == n
    assert not n or (env.min() >= 0 and env.max() <= 1)


def test_adsr_expression(spark):
    from pyspark.sql import functions as F

    for n, a, d, r in [(50, 5, 10, 8), (12, 5, 10, 8), (1, 1, 0, 0), (9, 0, 1, 1)]:
        lit = [F.lit(v).cast("long") for v in (n, a, d, r)]
        got = [x[0] for x in spark.range(n).orderBy("id").select(signal.adsr_at(F.col("id"), lit[0], lit[1], lit[2], 0.5, lit[3])).collect()]
        np.testing.assert_allclose(got, signal.adsr(n, a, d, 0.5, r), atol=1e-12)


def plain_pairs(events, total, rate):
    active, out = {}, []
    for seq, (kind, note, velocity, time) in enumerate(events):
        if int(time * rate) >= total or kind not in ("note_on", "note_off"):
            continue
        if kind == "note_on" and velocity > 0:
            active[note] = (time, velocity)
        elif note in active:
            start, v = active.pop(note)
            out.append((seq, note, v, start, time))
    return out


def test_pairs(spark):
    rng = np.random.default_rng(2)
    for _ in range(3):
        t = np.sort(np.round(rng.uniform(0, 1.3, 40), 2))
        events = [(["note_on", "note_off", "control"][rng.integers(3)], int(rng.integers(3)), int(rng.integers(0, 3)), float(x)) for x in t]
        df = spark.createDataFrame([(i, *e) for i, e in enumerate(events)], "seq int, type string, note int, velocity int, time double")
        got = sorted(tuple(r) for r in notes.pairs(df, 1.0, 100).collect())
        assert got == sorted(plain_pairs(events, 100, 100))


def test_swept_render_is_bounded_and_quiet_elsewhere(spark):
    y = {r.idx: r.y for r in notes.render(notes.events(spark), 3, 1.0, 2000).collect()}
    assert y and max(map(abs, y.values())) <= 1 and max(y) < 2000
    a = notes.swept_note(220.0, 0, 400, 0.1, 2000)
    b = notes.swept_note(220.0, 0, 400, 0.2, 2000)
    np.testing.assert_allclose(2 * a, b)


def test_noise_needs_a_seed(spark):
    one = lambda s: [r.y for r in notes.render(notes.events(spark), 2, 0.6, 500, s).orderBy("idx").collect()]
    assert one(5) == one(5) and one(5) != one(None)


def test_distance_uses_the_common_part(spark):
    df = spark.createDataFrame([([1.0, 2.0, 9.0], [1.0, 4.0])], "a array<double>, b array<double>")
    assert df.select(vec.distance(df.a, df.b)).first()[0] == 2.0


def plain_flush(chunks, gap, least, most):
    d, last, out = 0.0, None, []
    for at, s in chunks:
        if last is not None and d > least and at - last > gap:
            out.append(d)
            d = 0.0
        d += s
        last = at
        if d > most:
            out.append(d)
            d = 0.0
    return out + ([d] if d > least else [])


@given(st.lists(st.tuples(st.floats(0, 2), st.floats(0, 3)), max_size=40))
@settings(max_examples=100, deadline=None)
def test_flush_fold(steps):
    at, chunks = 0.0, []
    for gap, s in steps:
        at += gap
        chunks.append((at, s))
    f, out = ss.Flush(), []
    for a, s in chunks:
        out += f.add(a, s)
    tail = f.end()
    assert out + ([tail] if tail is not None else []) == plain_flush(chunks, 0.6, 1.0, 15.0)


def test_flush_boundaries(spark):
    chunks = [(1, 0.0, 0, 0.5), (1, 5.0, 1, 0.4), (1, 10.0, 2, 0.4), (1, 20.0, 3, 0.1), (2, 0.0, 0, 1.0), (2, 9.0, 1, 0.0), *((3, float(k) / 2, k, 1.0) for k in range(16))]
    df = spark.createDataFrame(chunks, "key long, at double, id long, seconds double")
    assert sorted(tuple(r) for r in ss.flushed(df).collect()) == [(1, 0, 1.3), (3, 0, 16.0)]


def test_audio_round_trip(spark, tmp_path):
    y = np.sin(2 * np.pi * 440 * np.arange(8000) / 8000) * 0.5
    (tmp_path / "a.WAV").write_bytes(audio.wav_bytes(y, 8000))
    (tmp_path / "bad.wav").write_bytes(b"RIFF")
    (tmp_path / "note.txt").write_text("x")
    rows = {r.file: r for r in audio.read_audio(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.WAV", "bad.wav"}
    assert rows["bad.wav"].y is None and rows["bad.wav"].error
    np.testing.assert_allclose(rows["a.WAV"].y, y, atol=1e-4)
    df = spark.createDataFrame([("out.wav", 8000, y.tolist())], "file string, rate int, y array<double>")
    audio.write_wavs(df, str(tmp_path / "w"))
    assert audio.wav_samples((tmp_path / "w" / "out.wav").read_bytes())[0] == 8000


def test_analyses_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, [1.0, 2.0]), (2, 0.25, [0.0, 1.0])], "version int, average_rms double, mfcc_means array<double>")
    audio.write_analyses(df, str(tmp_path / "lib"))
    (tmp_path / "s" / "7").mkdir(parents=True)
    (tmp_path / "s" / "7" / "analysis.json").write_text("{bad")
    (tmp_path / "s" / "8").mkdir()
    (tmp_path / "s" / "8" / "analysis.json").write_text('{"average_rms": 0.5,\n "mfcc_means": [1]}')
    got = {r.version: r for r in audio.read_analyses(spark, str(tmp_path / "s" / "*" / "analysis.json")).collect()}
    assert got[8].average_rms == 0.5 and got[7].corrupt is not None


def test_spectral_features():
    rate = 8000
    y = 0.5 * np.sin(2 * np.pi * 1000 * np.arange(rate) / rate)
    f = spectral.sound_features(y, rate)
    assert abs(f["average_spectral_centroid"] - 1000) < 60
    assert abs(f["average_zero_crossing_rate"] - 0.25) < 0.02
    assert len(f["mfcc_means"]) == spectral.COEFFICIENTS
    silent = spectral.sound_features(np.zeros(rate), rate)
    assert silent["estimated_tempo"] is None and silent["average_rms"] == 0
    clicks = np.zeros(rate * 4)
    clicks[:: rate // 2] = 1
    assert abs(spectral.sound_features(clicks, rate)["estimated_tempo"] - 120) < 8


def test_report_escapes(spark):
    df = spark.createDataFrame([("</script>", i, float(x)) for i, x in enumerate([0, 3, 0, 2])], "key string, i long, x double")
    page = sounds.html_report(sounds.report_rows(df))
    assert "</script>\"" not in page.split("<script>")[1].rsplit("</script>", 1)[0]


@pytest.mark.parametrize("value,want", [(2.0, 32767), (-2.0, -32767), (0.5, 16383), (-0.5, -16383)])
def test_to_int16(spark, value, want):
    from pyspark.sql import functions as F

    assert spark.range(1).select(signal.to_int16(F.lit(value))).first()[0] == want


def test_similarity_pairs_of_many_recordings(spark):
    many = 100_050
    frames = spark.range(2 * many).selectExpr("cast(id div 2 as string) as key", "id % 2 as i", "cast(id % 2 + 1 as double) as x")
    assert fr.similarity_pairs(frames).count() == many


def test_sound_queries_hold_the_whole_sequence(spark, monkeypatch):
    from sonarlake.plans import waves

    asked = []
    monkeypatch.setattr(sounds, "library", lambda s, seconds=5.0, rate=44100: asked.append((seconds, rate)) or spark.createDataFrame([("1", [0.0])], "key string, mfcc_means array<double>"))
    waves.sound_features(spark, "")
    waves.sound_distances(spark, "")
    for seconds, rate in asked:
        assert notes.pairs(notes.events(spark), seconds, rate).count() == 4
    assert len(asked) == 2
