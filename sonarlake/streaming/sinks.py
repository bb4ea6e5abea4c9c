"""Where live results go: posts, a first debug sample, counters."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..sources.audio import wav_bytes


def posts(said: DataFrame, send: Callable[[str], None]) -> DataStreamWriter:
    """A writer that sends ``**name**: text`` for each utterance; batches are small and go in order of ``seq``.

    A batch that is run again after a failure sends again; ``send`` should drop
    what it has by (query, batch).
    """

    def each(batch: DataFrame, _: int) -> None:
        for r in batch.orderBy("seq").select("name", "text").toLocalIterator():
            send(f"**{r.name}**: {r.text}")

    return said.writeStream.foreachBatch(each)


def first_long_sample(chunks: DataFrame, least_bytes: int) -> bytes | None:
    """The first buffer over a length as a WAV file, for listening to; one row comes to the driver."""
    row = chunks.where(F.length("pcm") > least_bytes).orderBy("ts").limit(1).select("pcm").first()
    if row is None:
        return None
    left = np.frombuffer(row.pcm, "<i2")[::2] / 32768.0
    return wav_bytes(left, 48_000)


def counted(packets: DataFrame) -> tuple[DataFrame, Observation]:
    """Packets with a running count of all and of those decoded, without another pass."""
    seen = Observation("packets")
    return packets.observe(seen, F.count("*").alias("all"), F.count("pcm").alias("decoded")), seen


def with_provenance(analyses: DataFrame, version: str, source: str) -> DataFrame:
    """Rows that say which renderer made them, and the hash of its source."""
    return analyses.withColumn("version", F.lit(version)).withColumn("source_hash", F.sha2(F.lit(source), 256))
