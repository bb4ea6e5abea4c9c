"""Audio files and buffers in, waveforms and analyses out.

WAV is read by the standard library; other suffixes are listed but need a decoder
that is passed in. A file that cannot be read becomes a row with an error.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ("wav", "mp3", "m4a", "flac", "ogg", "aiff")
SILENCE = b"\0" * 3840


def is_audio(path: Column) -> Column:
    """Has the path an audio suffix, in any case?"""
    return F.lower(path).rlike(r"\.(" + "|".join(SUFFIXES) + ")$")


def basename(path: Column) -> Column:
    """The file name of a path."""
    return F.element_at(F.split(path, "/"), -1)


def listed(paths: DataFrame, column: str = "path") -> DataFrame:
    """(file, path) of audio files, by name."""
    return paths.where(is_audio(F.col(column))).select(basename(F.col(column)).alias("file"), F.col(column).alias("path")).orderBy("file")


def wav_samples(raw: bytes) -> tuple[int, np.ndarray]:
    """(rate, mono samples in [-1, 1)) of a PCM WAV file of 8, 16, 24 or 32 bits."""
    with wave.open(io.BytesIO(raw)) as f:
        rate, width, channels = f.getframerate(), f.getsampwidth(), f.getnchannels()
        data = f.readframes(f.getnframes())
    if width == 1:
        y = (np.frombuffer(data, np.uint8).astype(float) - 128) / 128
    elif width == 3:
        raw3 = np.frombuffer(data, np.uint8).reshape(-1, 3)
        y = (np.pad(raw3, ((0, 0), (1, 0))).copy().view("<i4")[:, 0] / 2.0**31).astype(float)
    else:
        y = np.frombuffer(data, f"<i{width}") / 2.0 ** (8 * width - 1)
    return rate, y.reshape(-1, channels).mean(axis=1)


def wav_bytes(y: np.ndarray, rate: int) -> bytes:
    """A 16-bit mono WAV file; samples beyond full scale are clipped."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.clip(y, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def read_audio(spark: SparkSession, folder: str, decoder: Callable[[bytes], tuple[int, np.ndarray]] = wav_samples) -> DataFrame:
    """(file, rate, y, error) of the audio files of a folder, not of its subfolders."""
    files = spark.read.format("binaryFile").load(folder).where(is_audio(F.col("path"))).select(basename(F.col("path")).alias("file"), "content")

    def run(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rate, y, error = None, None, None
                try:
                    rate, y = decoder(raw)
                except Exception as e:  # noqa: BLE001 - any decoder failure becomes the row's error
                    error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rate], pa.int32()), pa.array([None if y is None else y.tolist()], pa.list_(pa.float64())), pa.array([error], pa.string())], ["file", "rate", "y", "error"])

    return files.mapInArrow(run, "file string, rate int, y array<double>, error string")


def decoded_or_silence(pcm: Column) -> Column:
    """A packet's samples, or a packet of silence where decoding gave none."""
    return F.coalesce(pcm, F.lit(SILENCE))


def write_wavs(sounds: DataFrame, folder: str) -> None:
    """Write (file, rate, y) rows as WAV files, each by the task that holds it."""

    def save(rows: Iterable) -> None:
        import os

        os.makedirs(folder, exist_ok=True)
        for r in rows:
            part = os.path.join(folder, f".{r.file}.part")
            with open(part, "wb") as f:
                f.write(wav_bytes(np.array(r.y), r.rate))
            os.replace(part, os.path.join(folder, r.file))  # whole or not at all

    sounds.select("file", "rate", "y").foreachPartition(save)


ANALYSIS = (
    "average_rms double, peak_rms double, average_spectral_centroid double, average_spectral_bandwidth double, average_spectral_flatness double, "
    "average_zero_crossing_rate double, estimated_tempo double, mfcc_means array<double>, distances map<string, double>"
)


def read_analyses(spark: SparkSession, pattern: str) -> DataFrame:
    """Analyses by version, from folders named by it; unreadable files give a row with ``corrupt``."""
    raw = spark.read.option("multiLine", True).option("columnNameOfCorruptRecord", "corrupt").schema(ANALYSIS + ", corrupt string").json(pattern)
    return raw.withColumn("version", F.regexp_extract(F.input_file_name(), r"/(\d+)/[^/]*$", 1).cast("int")).orderBy("version")


def write_analyses(df: DataFrame, folder: str) -> None:
    """Write analyses as JSON, one folder a version."""
    df.write.mode("overwrite").partitionBy("version").json(folder)


def chunk_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (speaker, ts, pcm) chunks from parquet files that drop into a folder."""
    return spark.readStream.schema("speaker string, ts timestamp, pcm binary").parquet(folder)
