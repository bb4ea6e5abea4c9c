"""Expressions over utterances: cleaning, sentence and word statistics, response parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEEP = r"(?U)[^\p{L}\p{N}_\s.!?]"
STATS = ("word_count", "avg_word_len", "min_word_len", "max_word_len", "avg_words_per_sentence", "min_words_per_sentence", "max_words_per_sentence")


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean(c: Column) -> Column:
    """Keep letters, digits, underscores, white space and sentence ends."""
    return F.regexp_replace(c, KEEP, "")


def sentence_words(c: Column) -> Column:
    """Words of each part between sentence ends; the last part is not ended."""
    return F.transform(F.split(clean(c), "[.!?]", -1), lambda p: F.filter(F.split(p, r"(?U)\s+"), lambda x: x != ""))


def _summary(values: Column, total: Column) -> list[Column]:
    n = F.size(values)
    zero = F.lit(0)
    return [
        F.when(n > 0, F.round(total / F.when(n > 0, n), 6)).otherwise(F.lit(0.0)),
        F.coalesce(F.array_min(values), zero).cast("int"),
        F.coalesce(F.array_max(values), zero).cast("int"),
    ]


def text_stats(c: Column) -> list[Column]:
    """The seven metrics of a speaker's whole text; 0 where there is nothing.

    A generator of one row: the text is cleaned and split once, its lengths are taken once.
    """
    add = lambda v: F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x)

    def lengths(parts: Column) -> Column:
        ended = F.filter(F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.size(p)), lambda n: n > 0)
        return F.struct(F.transform(F.flatten(parts), F.length).alias("lens"), ended.alias("ended"))

    def metrics(v: Column) -> Column:
        out = [F.size(v["lens"]).cast("long"), *_summary(v["lens"], add(v["lens"])), *_summary(v["ended"], add(v["ended"]))]
        return F.struct(*(x.alias(name) for x, name in zip(out, STATS)))

    return [F.inline(F.transform(F.transform(F.array(sentence_words(c)), lengths), metrics))]


def is_complete(segments: Column) -> Column:
    """Does any segment end in a sentence mark once stripped?"""
    return F.exists(segments, lambda s: strip(s).rlike("[.!?]$"))


def reply(c: Column) -> Column:
    """What follows the last assistant tag, stripped."""
    return strip(F.substring_index(c, "<|assistant|>", -1))


def key_phrase(c: Column, label: str = "Most Poetic Phrase:") -> Column:
    """The labelled phrase, else what stands between the first two quotes, else null."""
    after = F.get(F.split(c, label, 2), F.lit(1))
    line = F.get(F.split(strip(after), r"\n", 2), F.lit(0))
    bare = F.regexp_replace(F.regexp_replace(strip(line), '^"+|"+$', ""), "^'+|'+$", "")
    quoted = F.get(F.split(c, '"', 3), F.lit(1))
    return F.when(F.contains(c, F.lit(label)), bare).when(F.contains(c, F.lit('"')), quoted)


def chat_prompt(system: str, text: Column) -> Column:
    """A two-message conversation as JSON; the template belongs to the model."""
    message = lambda role, body: F.struct(F.lit(role).alias("role"), body.alias("content"))
    return F.to_json(F.array(message("system", F.lit(system)), message("user", text)))


def speaker_line(name: Column, words: Column, avg_len: Column, avg_sentence: Column) -> Column:
    """A line of the statistics report."""
    return F.format_string("%s: %d words, %.1f letters a word, %.2f words a sentence", name, words, avg_len, avg_sentence)


def guest_name(name: Column, ssrc: Column) -> Column:
    """A speaker's name, or a stand-in by stream number."""
    return F.coalesce(name, F.concat(F.lit("Guest-"), ssrc.cast("string")))
