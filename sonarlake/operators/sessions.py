"""Speech sessions with a least and a most length, and windows closed by a token count.

The rules are plain folds (:class:`Flush`, :class:`TokenWindow`) that the batch
operators here and the streaming ones share. In batch, rows are spread by key and
sorted, and a fold reads them as they come: it holds one key's state, never its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP, LEAST, MOST = 0.6, 1.0, 15.0
TOKENS = 100


class Flush:
    """Close a buffer on a pause if it is long enough, or when it is too long."""

    def __init__(self, gap: float = GAP, least: float = LEAST, most: float = MOST, length: float = 0.0, last: float | None = None) -> None:
        self.gap, self.least, self.most = gap, least, most
        self.length, self.last = length, last

    def pause(self, now: float) -> float | None:
        """What to emit if nothing has come until now."""
        if self.last is not None and self.length > self.least and now - self.last > self.gap:
            out, self.length = self.length, 0.0
            return out
        return None

    def add(self, at: float, length: float) -> Iterator[float]:
        """What to emit as a chunk arrives."""
        if (out := self.pause(at)) is not None:
            yield out
        self.length += length
        self.last = at
        if self.length > self.most:
            out, self.length = self.length, 0.0
            yield out

    def end(self) -> float | None:
        """What to emit at the end of bounded input."""
        return self.length if self.length > self.least else None


class TokenWindow:
    """Collect texts until there are enough tokens; then emit, and begin anew from a seed."""

    def __init__(self, most: int = TOKENS, count: int = 0, texts: int = 0) -> None:
        self.most, self.count, self.texts = most, count, texts

    def add(self, tokens: int, seed_tokens: int = 0) -> tuple[int, int] | None:
        """(tokens, texts) of a window that this text closes."""
        self.count += tokens
        self.texts += 1
        if self.count < self.most:
            return None
        out = (self.count, self.texts)
        self.count, self.texts = seed_tokens, 0
        return out


def folded(df: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable, schema: str, finish: Callable | None = None) -> DataFrame:
    """Fold rows (key, *others) by key in order; memory is one state and one batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []
        kinds = None
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            kinds = kinds or pa.schema([b.schema.field(0)])
            for k, *rest in zip(*cols):
                if state is None or k != now:
                    if state is not None and finish:
                        out += [(now, *x) for x in finish(state)]
                    now, state = k, start()
                out += [(k, *x) for x in step(state, *rest)]
            if len(out) > 10_000:
                yield pack(out)
                out = []
        if state is not None and finish:
            out += [(now, *x) for x in finish(state)]
        if out:
            yield pack(out)

    names = [part.split()[0] for part in schema.split(", ")]
    kind = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "int": pa.int32()}
    types = [kind[part.split()[1]] for part in schema.split(", ")]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def flushed(chunks: DataFrame, gap: float = GAP, least: float = LEAST, most: float = MOST) -> DataFrame:
    """(key, n, seconds) of the utterances of chunks (key, at, id, seconds); n counts from 0."""
    rows = chunks.select("key", "at", "id", "seconds")

    def start() -> list:
        return [Flush(gap, least, most), 0]

    def step(state: list, at: float, _: int, seconds: float) -> Iterator[tuple]:
        for out in state[0].add(at, seconds):
            yield state[1], round(out, 6)
            state[1] += 1

    def finish(state: list) -> Iterator[tuple]:
        if (out := state[0].end()) is not None:
            yield state[1], round(out, 6)

    return folded(rows, "key", ["at", "id"], start, step, "key long, n long, seconds double", finish)


def token_windows(texts: DataFrame, most: int = TOKENS) -> DataFrame:
    """(key, last, tokens, texts): windows of texts (key, at, tokens) closed by their token count."""

    def step(state: TokenWindow, at: int, tokens: int) -> Iterator[tuple]:
        if got := state.add(tokens):
            yield (at, *got)

    return folded(texts.select("key", "at", "tokens"), "key", ["at"], lambda: TokenWindow(most), step, "key long, last long, tokens long, texts long")


def gap_sessions(df: DataFrame, key: str, at: Column, order: list[str], gap: float) -> DataFrame:
    """Rows numbered by session: a new one begins after a pause longer than ``gap``."""
    w = Window.partitionBy(key).orderBy(*order)
    new = (at - F.lag(at).over(w) > gap).cast("long")
    return df.withColumn("_new", F.coalesce(new, F.lit(0).cast("long"))).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def first_match(df: DataFrame, name: str, wanted: str, default: str, order: str) -> DataFrame:
    """The first name by ``order`` that contains ``wanted``, or ``default``; one row."""
    return df.where(F.contains(F.col(name), F.lit(wanted))).agg(F.coalesce(F.min_by(name, order), F.lit(default)).alias("chosen"))
