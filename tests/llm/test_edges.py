"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from sonarlake.llm import decontaminate, html, langid, lines, media, neardup, packing, pii, substrings, toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
PASSAGE = " ".join(f"{a}{b}" for a, b in zip(WORDS, reversed(WORDS))) + ". " + " ".join(a + "x" + b for a, b in zip(WORDS, WORDS[3:])) + " and so it ends."
LONG = "\n".join(" ".join(f"w{k}q{j}" for j in range(9)) for k in range(3000)) + " " + "z" * 150_000
ROWS = [
    (1, PASSAGE, "en"), (2, None, "en"), (3, "", None), (4, LONG, "en"), (5, PASSAGE, "fr"), (5, PASSAGE, "fr"), (6, "idiot 4111 1111 1111 1111 a@b.co", "fr"), (7, "12 34 !!", "en"),
    (None, "lost words here", None), (8, "same same same same same same same same same", "de"), (9, "été naïve \U0001f600", "de"), (10, "\n\n\n", "en"),
]
SCHEMA = "doc_id long, text string, lang string"
CLASH = ["score", "held_out", "n", "key", "node", "n_lines", "n_removed", "_gone", "_id", "s", "h", "row", "label", "list", "start"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.select("*", *(F.lit("x").alias(c) for c in CLASH)).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0), (4, 0), (5, 0), (6, 1), (6, 0), (None, 1), (7, None), (8, 0), (99, 1)], "doc_id long, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (4, "never seen wordsoftheitem at all here")], "item_id long, text string")


def count(df):
    rows = df.collect()
    return len(rows), rows


def test_toxicity(spark, docs, labels):
    n, rows = count(toxicity.toxicity(docs, labels))
    assert n == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert {r.score for r in rows if r.doc_id in (2, 3)} == {r.score for r in rows if r.doc_id == 3}
    assert all(r.score == 0 for r in toxicity.toxicity(docs, labels.limit(0)).collect())
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_pii(docs):
    n, rows = count(pii.find_pii(docs))
    six = next(r for r in rows if r.doc_id == 6)
    assert n == len(ROWS) and six.n_card == 1 and six.n_email == 1 and six.spans.startswith("email:26:32,card:6:25")
    assert all(r.spans == "" for r in rows if r.doc_id in (2, 3))
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_media(docs):
    n, rows = count(media.text_media(docs))
    by = {r.doc_id: r for r in rows}
    assert n == len(ROWS) and by[2][1:] == by[3][1:] and by[2].payload_bytes == 64 and by[2].n_bytes == 0
    assert by[4].payload_bytes % 64 == 0 and by[1][1:] == by[5][1:]
    assert media.text_media(docs.limit(0)).count() == 0


def test_packing(docs):
    n, rows = count(packing.pack_documents(docs))
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for off, size in sorted(parts):
            assert off == at
            at += size
        assert at <= 1024
    assert sum(r.piece == 0 for r in rows) == len(ROWS)
    assert {r.length for r in rows if r.doc_id in (2, 3)} == {1}
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_lines(docs):
    n, rows = count(lines.line_dedup(docs, keep=[]))
    by = {r.doc_id: r for r in rows}
    assert n == len(ROWS) and by[2].text is None and by[3].text == "" and by[4].text == LONG and by[4].n_removed == 0
    assert by[1].text == PASSAGE and by[5].text == ""
    assert by[10].text == "" and by[10].n_removed == 3  # a window of empty lines repeats itself: one line is left
    wide = lines.line_dedup(docs)
    assert set(docs.columns) < set(wide.columns) and "_n_lines" in wide.columns
    assert lines.line_dedup(docs.limit(0)).count() == 0


def test_langid(docs):
    n, rows = count(langid.predict(docs, langid.train(langid.sample(docs))))
    assert n == len(ROWS) and {r.lang_pred for r in rows if r.doc_id in (2, 3, 7, 10)} == {"und"}
    assert all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(docs.limit(0), None).count() == 0
    assert langid.train(langid.sample(docs.limit(0))) is None


def test_neardup(docs):
    n, rows = count(neardup.near_duplicates(docs))
    by = {r.doc_id: r for r in rows}
    assert n == len(ROWS) and by[5].class_id == 1 and by[2].class_id == by[3].class_id == 2 and by[4].class_id == 4
    assert by[1].is_kept and not by[5].is_kept
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_substrings(docs):
    n, rows = count(substrings.repeated_paragraphs(docs))
    assert n and {r.doc_id for r in rows if r.removed} == {5} and {r.first_doc_id for r in rows} == {1}
    assert substrings.repeated_paragraphs(docs.limit(0)).count() == 0


def test_leaks(docs, bench):
    n, rows = count(decontaminate.leaks(docs, bench))
    assert {(r.doc_id, r.item_id) for r in rows} == {(1, 1), (5, 1)} and n == 2
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0


def test_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>" * 3000 + "deep text here.</p>"), (3, "u", "<p>" * 3000 + "deep text here.</p>"), (4, "u", "no markup &amp; &am"), (5, "u", "<article><p>A <b>b</b>ig\n&nbsp; deal.<script>x</script><p>Two</article><footer>f</footer>"), (6, "u", "<" * 1000 + "<!-- open")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = [(r.page_id, r.text, r.n_chars) for r in html.extract(df).collect()]
    assert (1, "", 0) in got and (2, "", 0) in got and (5, "A big deal.\nTwo", 15) in got and len(got) == len(rows)
    assert html.extract(df.limit(0)).count() == 0
