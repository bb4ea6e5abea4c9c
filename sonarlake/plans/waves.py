"""Queries over envelopes, vectors, notes and samples."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import buffers, signal
from ..operators import frames as fr
from ..operators import notes, sounds
from ..operators import vectors as vec
from .registry import query, table


def _envelope(spark: SparkSession, sf_dir: str, width: int = 3600) -> DataFrame:
    return fr.envelope(table(spark, sf_dir, "events"), "event_type", "ts", "value", width)


def _frames_sql(width: int = 3600) -> str:
    return f"""fs as (select event_type as key, cast(floor(epoch(ts) / {width}) as bigint) as frame, sum(value) as x from events group by 1, 2),
f as (select key, row_number() over (partition by key order by frame) - 1 as i, frame * {width} as t, round(x, 6) as x from fs),
m as (select key, max(x) as max_x, max(x) - min(x) as max_dist, count(*) as n from f group by key),
g as (select key, case when max_x > 0 then max_x else 1 end as mx, case when max_dist > 0 then max_dist else 1 end as md from m)"""


_WIDE = 21_600
_PAIRS = f"""with {_frames_sql(_WIDE)},
s as (select a.key, a.i, b.i as j, a.x as xi, b.x as xj, a.t as ti, b.t as tj, (1 - abs(a.x - b.x) / md) * least(a.x / mx, b.x / mx) as s from f a join f b on a.key = b.key and a.i < b.i join g on g.key = a.key)"""
_TOP = f"{_PAIRS}, r as (select *, row_number() over (partition by key order by round(s, 12) desc, i, j) as k from s)"


@query("envelope_frames", f"with {_frames_sql()} select key, i, t, x from f")
def envelope_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly sums of events by type, as an envelope."""
    return _envelope(spark, sf_dir)


@query("envelope_normalize", f"with {_frames_sql()} select key, i, round(x / mx, 9) as x_norm from f join g using (key)")
def envelope_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The envelope over its maximum."""
    return fr.normalize(_envelope(spark, sf_dir)).select("key", "i", F.round("x_norm", 9).alias("x_norm"))


@query(
    "peaks",
    f"""with {_frames_sql()},
c as (select *, lag(x) over w as before, lead(x) over w as after from f window w as (partition by key order by i)),
p as (select key, i, x from c where x > before and x > after),
b as (select p.key, p.i, p.x, coalesce(max(q.i) filter (q.i < p.i and q.x > p.x), -1) as l, coalesce(min(q.i) filter (q.i > p.i and q.x > p.x), 1000000000) as r from p join f q on q.key = p.key group by 1, 2, 3),
d as (select b.key, b.i, b.x, b.x - greatest(min(q.x) filter (q.i between l and b.i), min(q.x) filter (q.i between b.i and r)) as prominence from b join f q on q.key = b.key group by b.key, b.i, b.x, l, r)
select key, i, x, round(prominence, 6) as prominence from d where prominence >= 0.5""",
)
def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local maxima that stand out by half a unit."""
    return fr.peaks(_envelope(spark, sf_dir)).select("key", "i", "x", F.round("prominence", 6).alias("prominence"))


@query("ssm_pairs", f"{_PAIRS} select key, i, j, round(s, 9) as s from s")
def ssm_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted similarity of all pairs of six-hour frames of a type."""
    return fr.similarity_pairs(_envelope(spark, sf_dir, _WIDE)).select("key", "i", "j", F.round("s", 9).alias("s"))


@query("ssm_top", f"{_TOP} select key, i, j, round(s, 9) as s from r where k = 1")
def ssm_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar pair of each type, from all pairs; an aggregate, so no sort of them."""
    pairs = fr.similarity_pairs(_envelope(spark, sf_dir, _WIDE))
    best = pairs.groupBy("key").agg(F.max_by(F.struct("i", "j", "s"), F.struct(F.round("s", 12).alias("s"), (-F.col("i")).alias("i"), (-F.col("j")).alias("j"))).alias("b"))
    return best.select("key", "b.i", "b.j", F.round("b.s", 9).alias("s"))


@query("ssm_top_fast", f"{_TOP} select key, i, j, round(s, 9) as s from r where k = 1")
def ssm_top_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pair by one sort of the frames."""
    return fr.most_similar(_envelope(spark, sf_dir, _WIDE)).select("key", "i", "j", F.round("s", 9).alias("s"))


@query(
    "peak_similarity_record",
    f"""{_TOP} select r.key, ti as time_i, tj as time_j, xi as onset_i, xj as onset_j, round(max_dist, 6) as max_dist, max_x as max_onset, round(s, 9) as final_similarity,
  round(xi / mx, 9) as norm_i, round(xj / mx, 9) as norm_j, round(1 - abs(xi - xj) / md, 9) as base_similarity from r join m on m.key = r.key join g on g.key = r.key where k = 1""",
)
def peak_similarity_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of each type's most similar pair, with what a reader recomputes from it."""
    env = _envelope(spark, sf_dir, _WIDE)
    top = fr.most_similar(env)
    times = env.select("key", "i", "t")
    both = top.join(times.withColumnRenamed("t", "time_i"), ["key", "i"]).join(times.select("key", F.col("i").alias("j"), F.col("t").alias("time_j")), ["key", "j"])
    mx, md = fr.guard(F.col("max_x")), fr.guard(F.col("max_dist"))
    return both.select("key", "time_i", "time_j", F.col("xi").alias("onset_i"), F.col("xj").alias("onset_j"), F.round("max_dist", 6).alias("max_dist"), F.col("max_x").alias("max_onset"), F.round("s", 9).alias("final_similarity"), F.round(F.col("xi") / mx, 9).alias("norm_i"), F.round(F.col("xj") / mx, 9).alias("norm_j"), F.round(1 - F.abs(F.col("xi") - F.col("xj")) / md, 9).alias("base_similarity"))


@query("binned_matrix", f"{_PAIRS} select s.key, cast(floor(i * 16 / n) as bigint) as bi, cast(floor(j * 16 / n) as bigint) as bj, round(avg(s), 6) as s from s join m on m.key = s.key group by 1, 2, 3")
def binned_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarity matrix on a fixed grid."""
    return sounds.binned_matrix(_envelope(spark, sf_dir, _WIDE), 16).select("key", "bi", "bj", F.round("s", 6).alias("s"))


@query("report_json")
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON report of each type's envelope."""
    return sounds.report_rows(_envelope(spark, sf_dir, _WIDE))


@query("rms_by_key", "select user_id, round(stddev_pop(value), 4) as rms, count(*) as n from events group by 1")
def rms_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root mean square about the mean, by user, in one partially aggregated pass."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.stddev_pop("value"), 4).alias("rms"), F.count("*").alias("n"))


@query("silence_filter", "select user_id, cast(ts as date) as day, round(sqrt(avg(value * value)), 4) as rms, count(*) as n from events group by 1, 2 having sqrt(avg(value * value)) >= 100")
def silence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of a user that are not silent."""
    loud = fr.louder_than(fr.rms_by(table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), ["user_id", "day"], F.col("value")))
    return loud.select("user_id", "day", F.round("rms", 4).alias("rms"), "n")


@query(
    "zcr_by_key",
    """with e as (select user_id, cast(value - 50 < 0 as int) as neg, lag(cast(value - 50 < 0 as int)) over (partition by user_id order by ts, event_id) as was from events)
select user_id, round(coalesce(sum(cast(neg <> was as int)), 0) / count(*), 9) as zcr from e group by 1""",
)
def zcr_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign changes about 50 by user, in time order."""
    return fr.sign_changes(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("value") - 50).select("user_id", F.round("zcr", 9).alias("zcr"))


@query("first_difference", f"with {_frames_sql()} select key, i, round(x - coalesce(lag(x) over (partition by key order by i), 0), 6) as diff from f")
def first_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of the envelope from frame to frame."""
    return fr.first_difference(_envelope(spark, sf_dir), "key", "i", "x").select("key", "i", F.round("diff", 6).alias("diff"))


_MEANS = "e as (select label, unnest(embedding) as v, unnest(range(0, len(embedding))) as k from embeddings), mk as (select label as key, k, avg(cast(v as double)) as m from e group by 1, 2)"
_DISTANCES = f"with {_MEANS}, d as (select a.key as a, b.key as b, sqrt(sum((a.m - b.m) * (a.m - b.m))) as d from mk a join mk b on a.k = b.k and a.key <> b.key group by 1, 2)"


@query("vector_means", f"with {_MEANS} select key, k, round(m, 6) as m from mk")
def vector_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vectors by label, a row a place."""
    return vec.means(table(spark, sf_dir, "embeddings"), "label", "embedding").select("key", F.posexplode("mean").alias("k", "m")).select("key", F.col("k").cast("long").alias("k"), F.round("m", 6).alias("m"))


@query("vector_distance_pairs", f"{_DISTANCES} select a, b, round(d, 6) as d from d")
def vector_distance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of all ordered pairs of labels' mean vectors."""
    return vec.all_pairs(vec.means(table(spark, sf_dir, "embeddings"), "label", "embedding")).select("a", "b", F.round("d", 6).alias("d"))


@query("distance_mean", f"{_DISTANCES} select a, round(avg(d), 6) as mean, count(*) as n from d group by 1")
def distance_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean distance of a label to the others."""
    maps = vec.distance_maps(vec.all_pairs(vec.means(table(spark, sf_dir, "embeddings"), "label", "embedding")))
    return maps.select("a", F.round("mean", 6).alias("mean"), F.size("distances").cast("long").alias("n"))


@query("library_distances", "select e.vec_id, round(list_distance(e.embedding::double[], o.embedding::double[]), 6) as d from embeddings e, (select embedding from embeddings where vec_id = 0) o where e.vec_id <> 0")
def library_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vector against every other."""
    return vec.against_one(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0).select("vec_id", F.round("d", 6).alias("d"))


@query("gain", "select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double * 0.5)), 5) as total, round(embedding[1]::double * 0.5, 6) as first, len(embedding) as n, len(embedding) in (1, 2) as layout from embeddings")
def gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as buffers at half their level."""
    y = signal.gain(F.col("embedding"), 0.5)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(y, F.lit(0.0), lambda s, v: s + v), 5).alias("total"), F.round(F.get(y, F.lit(0)), 6).alias("first"), F.size("embedding").cast("long").alias("n"), signal.layout_ok(F.size("embedding"), F.size("embedding")).alias("layout"))


@query(
    "pcm_roundtrip",
    """select event_id, cast(trunc(greatest(least(value / 250 - 1, 1.0), -1.0) * 32767) as int) as pcm, round(trunc(greatest(least(value / 250 - 1, 1.0), -1.0) * 32767) / 32768.0, 9) as back,
  round(event_id * 4 / 192000.0, 9) as at from events where event_id % 3 = 0""",
)
def pcm_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values to 16-bit samples and back, every third one kept."""
    pcm = signal.to_int16(F.col("value") / 250 - 1)
    kept = table(spark, sf_dir, "events").where(F.col("event_id") % 3 == 0)
    return kept.select("event_id", pcm.alias("pcm"), F.round(signal.to_float(pcm), 9).alias("back"), F.round(F.col("event_id") * 4 / F.lit(float(signal.BYTES_PER_SECOND)), 9).alias("at"))


_ODD = [("note_on", 50, 90, 0.1), ("note_on", 50, 80, 0.2), ("note_off", 50, 0, 0.4), ("note_off", 50, 0, 0.5), ("note_off", 51, 0, 0.6), ("note_on", 52, 70, 0.7), ("note_on", 53, 60, 0.8), ("note_on", 53, 0, 0.9), ("control", 53, 1, 0.95), ("note_on", 54, 60, 3.2), ("note_off", 54, 0, 9.0)]
_SECONDS, _RATE = 3.5, 2000


def _midi(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *e) for i, e in enumerate([*notes.EVENTS, *_ODD])], "seq int, type string, note int, velocity int, time double")


_EVENTS = ", ".join(f"({i}, '{t}', {n}, {v}, {float(s)}::double)" for i, (t, n, v, s) in enumerate([*notes.EVENTS, *_ODD]))
_NOTES = f"""mi(seq, type, note, velocity, time) as (values {_EVENTS}),
ev as (select *, type = 'note_on' and velocity > 0 as is_on from mi where floor(time * {_RATE}) < {int(_SECONDS * _RATE)} and type in ('note_on', 'note_off')),
lg as (select *, lag(is_on) over w as was_on, lag(time) over w as start, lag(velocity) over w as vel from ev window w as (partition by note order by seq)),
np as (select seq, note, vel as velocity, start, time as stop from lg where not is_on and was_on)"""


@query("note_pairing", f"with {_NOTES} select seq, note, velocity, start, stop, round(440 * pow(2, (note - 69) / 12.0), 6) as hz from np")
def note_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases and the strikes that they end."""
    return notes.pairs(_midi(spark), _SECONDS, _RATE).select("seq", "note", "velocity", "start", "stop", F.round(signal.note_hz(F.col("note")), 6).alias("hz"))


def _render_sql(version: int) -> str:
    a, d, s, r, loud = notes.VOICES[version]
    whole = [int(v * _RATE) for v in (a, d, r)]
    turn = f"(2 * {math.pi!r} * hz * (k / {float(_RATE)}))"
    tone = f"sin({turn}) + 0.4 * sin(2 * {turn}) + 0.2 * sin(3 * {turn}) + 0.1 * sin(4 * {turn})" if version == 1 else f"sin({turn} + 5.0 * sin(3.5 * {turn}))"
    level = "greatest(least(sum(y), 1.0), -1.0)" if version == 1 else "tanh(sum(y))"
    ramp = lambda at, n, lo, hi: f"case when {n} > 1 then {lo} + ({hi} - {lo}) * ({at}) / ({n} - 1)::double else {lo} end"
    return f"""with {_NOTES},
sp as (select *, cast(floor(start * {_RATE}) as bigint) as first, cast(floor((stop - start + {r}::double) * {_RATE}) as bigint) as size, 440 * pow(2::double, (note - 69) / 12::double) as hz from np),
nn as (select *, least(first + size, {int(_SECONDS * _RATE)}) - first as n from sp),
ad as (select *, case when {sum(whole)} > n then floor({whole[0]} * (n / {float(sum(whole))}::double))::bigint else {whole[0]} end as a, case when {sum(whole)} > n then floor({whole[1]} * (n / {float(sum(whole))}::double))::bigint else {whole[1]} end as d,
  case when {sum(whole)} > n then floor({whole[2]} * (n / {float(sum(whole))}::double))::bigint else {whole[2]} end as r, case when {sum(whole)} > n then 0 else n - {sum(whole)} end as h from nn where n > 0),
kk as (select *, unnest(range(0, n)) as k from ad),
yy as (select first + k as idx, ({tone}) * velocity / 127.0::double * {loud} * case when k < a then {ramp('k', 'a', 0.0, 1.0)} when k < a + d then {ramp('k - a', 'd', 1.0, s)} when k < a + d + h then {s} when k < a + d + h + r then {ramp('k - a - d - h', 'r', s, 0.0)} else 0.0 end as y from kk)
select idx, round({level}, 6) + 0.0 as y from yy group by idx"""


def _rendered(spark: SparkSession, version: int) -> DataFrame:
    return notes.render(_midi(spark), version, _SECONDS, _RATE).select("idx", (F.round("y", 6) + 0.0).alias("y"))


@query("render_v1", _render_sql(1))
def render_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additive tones, mixed and clipped."""
    return _rendered(spark, 1)


@query("render_v2", _render_sql(2))
def render_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequency-modulated tones without noise, mixed and softly clipped."""
    return _rendered(spark, 2)


@query("render_v3")
def render_v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sawtooth tones through a swept filter."""
    return _rendered(spark, 3)


@query("sound_features")
def sound_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectral features of the default sequence in every voice."""
    return sounds.library(spark)


@query("sound_distances")
def sound_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of the voices by their mean coefficients."""
    lib = sounds.library(spark).select("key", F.col("mfcc_means").alias("mean"))
    return vec.all_pairs(lib).select("a", "b", F.round("d", 6).alias("d"))


@query(
    "channel_buffers",
    """with e as (select vec_id, list_transform(embedding, lambda x: x::double) as y from embeddings)
select vec_id, round(list_sum(list_transform(range(1, 33), lambda i: (y[2 * i - 1] + y[2 * i]) / 2 * i)), 5) as mono, round(list_sum(y) * 2, 5) as stereo, cast(80 as bigint) as padded, round(y[5], 6) as fifth, round(list_sum(y), 5) as kept from e""",
)
def channel_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as interleaved buffers: mixed down, doubled, padded, one channel cleared."""
    y = F.col("embedding")
    down = F.transform(buffers.mono(y), lambda v, i: v * (i + 1))
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))
    two = buffers.cleared(F.array(y.cast("array<double>"), y.cast("array<double>")), 1)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.round(add(down), 5).alias("mono"), F.round(add(buffers.stereo(y)), 5).alias("stereo"), F.size(buffers.sized(y, 80)).cast("long").alias("padded"),
        F.round(F.get(buffers.preview(y), F.lit(4)).cast("double"), 6).alias("fifth"), F.round(add(F.flatten(two)), 5).alias("kept"),
    )
