"""Live speech: keyed buffers, silence, statistics, and summaries at a token count.

State is a few numbers per speaker. The folds are those of the batch operators.
Speech-to-text and language models are functions that the caller passes in.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import STATS
from ..operators.sessions import GAP, LEAST, MOST, TOKENS, Flush, TokenWindow


class FlushProcessor(StatefulProcessor):
    """Utterances of a speaker's chunks, closed by event time or by a timer after the pause."""

    def __init__(self, gap: float = GAP, least: float = LEAST, most: float = MOST) -> None:
        self.rule = (gap, least, most)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("buffer", "length double, last double")

    def _load(self) -> Flush:
        return Flush(*self.rule, *(self.state.get() if self.state.exists() else (0.0, None)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        flush, out = self._load(), []
        whole = pd.concat(list(rows)).sort_values(["at", "id"])  # one speaker's chunks of one batch
        for at, seconds in zip(whole["at"], whole["seconds"]):
            out += flush.add(float(at), float(seconds))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int((flush.last + self.rule[0]) * 1000) + 1)
        self.state.update((flush.length, flush.last))
        yield pd.DataFrame({"key": [key[0]] * len(out), "seconds": [round(x, 6) for x in out]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        flush = self._load()
        out = flush.pause(expiredTimerInfo.getExpiryTimeInMs() / 1000)
        if out is not None:
            self.state.update((flush.length, flush.last))
            yield pd.DataFrame({"key": [key[0]], "seconds": [round(out, 6)]})

    def close(self) -> None:
        pass


def utterances(chunks: DataFrame, gap: float = GAP, least: float = LEAST, most: float = MOST, late: str = "5 seconds") -> DataFrame:
    """A stream (key, seconds) of utterances from a stream (key, ts, id, seconds)."""
    timed = chunks.withColumn("at", F.col("ts").cast("double")).withWatermark("ts", late)
    return timed.groupBy("key").transformWithStateInPandas(FlushProcessor(gap, least, most), "key string, seconds double", "Append", "EventTime")


class SummaryProcessor(StatefulProcessor):
    """Texts until there are enough tokens, then a summary; its phrase seeds the next window.

    The window is replaced in the same state change that emits, so no text is lost
    between them, and a failing model fails the batch, which is then run again.
    """

    def __init__(self, summarize: Callable[[str], tuple[str, str | None]], most: int = TOKENS, count: Callable[[str], int] = lambda s: len(s.split())) -> None:
        self.summarize, self.most, self.count = summarize, most, count

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", "text string, tokens int, texts int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        text, tokens, texts = self.state.get() if self.state.exists() else ("", 0, 0)
        out = []
        for _, r in pd.concat(list(rows)).sort_values("seq").iterrows():
            window = TokenWindow(self.most, tokens, texts)
            text = f"{text}\n{r.text}" if text else r.text
            closed = window.add(self.count(r.text))
            tokens, texts = window.count, window.texts
            if closed:
                summary, phrase = self.summarize(text)
                out.append((key[0], summary, *closed))
                text = f"Legacy: {phrase}" if phrase else ""
                tokens = self.count(text)
        self.state.update((text, tokens, texts))
        yield pd.DataFrame(out, columns=["key", "summary", "tokens", "texts"])

    def close(self) -> None:
        pass


def summaries(texts: DataFrame, summarize: Callable[[str], tuple[str, str | None]], most: int = TOKENS) -> DataFrame:
    """A stream (key, summary, tokens, texts) from a stream (key, seq, text)."""
    return texts.groupBy("key").transformWithStateInPandas(SummaryProcessor(summarize, most), "key string, summary string, tokens int, texts int", "Append", "None")


def audible(chunks: DataFrame, level: float = 100.0) -> DataFrame:
    """Chunks that are not silence, by the RMS of their 16-bit samples; before any model sees them."""

    @F.pandas_udf("double")
    def rms(pcm: pd.Series) -> pd.Series:
        import numpy as np

        return pcm.map(lambda b: float(np.sqrt(np.mean(np.frombuffer(b, "<i2", len(b) // 2).astype(float) ** 2))) if b and len(b) > 1 else 0.0)

    return chunks.withColumn("rms", rms("pcm")).where(F.col("rms") >= level)


def transcribed(chunks: DataFrame, model: Callable[[bytes], str]) -> DataFrame:
    """``chunks`` with (text, error): a failing or missing model gives an error, not speech."""

    @F.pandas_udf("text string, error string")
    def run(pcm: pd.Series) -> pd.DataFrame:
        out = []
        for b in pcm:
            try:
                out.append((model(b), None))
            except Exception as e:  # noqa: BLE001 - any model failure becomes the row's error
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["text", "error"])

    return chunks.withColumn("_t", run("pcm")).select(*chunks.columns, "_t.text", "_t.error")


class StatsProcessor(StatefulProcessor):
    """The seven metrics of each speaker so far; a sentence goes on from one utterance to the next.

    State is nine numbers: words, letters, shortest, longest; sentences, their words,
    shortest, longest; and the words of the sentence that is not ended.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("stats", ", ".join(f"v{k} long" for k in range(9)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, letters, short, long_, ends, total, few, many, now = self.state.get() if self.state.exists() else (0,) * 9
        for text in pd.concat(list(rows)).sort_values("seq")["text"]:
            for part in re.split(r"([.!?])", re.sub(r"[^\w\s.!?]", "", text or "")):
                if part in (".", "!", "?"):
                    if now:
                        few, many = (min(few, now), max(many, now)) if ends else (now, now)
                        ends, total, now = ends + 1, total + now, 0
                    continue
                for w in part.split():
                    short, long_ = (min(short, len(w)), max(long_, len(w))) if n else (len(w), len(w))
                    n, letters, now = n + 1, letters + len(w), now + 1
        self.state.update(tuple(map(int, (n, letters, short, long_, ends, total, few, many, now))))
        yield pd.DataFrame([(key[0], n, round(letters / n, 6) if n else 0.0, short, long_, round(total / ends, 6) if ends else 0.0, few, many)], columns=["key", *STATS])

    def close(self) -> None:
        pass


def running_stats(texts: DataFrame) -> DataFrame:
    """A stream (key, the seven metrics so far) from a stream (key, seq, text), a row for each speaker heard in a batch."""
    schema = "key string, word_count long, avg_word_len double, min_word_len int, max_word_len int, avg_words_per_sentence double, min_words_per_sentence int, max_words_per_sentence int"
    return texts.groupBy("key").transformWithStateInPandas(StatsProcessor(), schema, "Update", "None")
