"""The pipeline's stages on a small corpus whose right outcome is known."""

from __future__ import annotations

import random

import corpus_pipeline as cp
from test_methods import words_of


def corpus(spark, folder):
    rng = random.Random(20)
    text = lambda n: " ".join(words_of(rng, n))
    docs, labels, toxic = {}, [], set()
    for k in range(200):
        docs[k] = text(80)
        if k % 4 == 0:
            x = docs[k].split()
            x[10:10] = ["grumbol", "vextig"]
            docs[k] = " ".join(x)
            toxic.add(k)
        labels.append((k, 90, int(k in toxic)))
    item = text(40) + ". " + text(8) + "."
    run = "\n".join(text(20) for _ in range(4))
    docs[300] = text(60) + " " + item + " " + text(60)
    docs[301] = run + "\n" + text(50)
    docs[302] = text(50) + "\n" + run + "\n" + text(30)
    docs[303] = docs[1] + " " + text(2)
    docs[304] = docs[1]
    docs[305], docs[306] = "", None
    rows = [(k, t, "en", "s", len(t or "")) for k, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, toxic, run


def test_stages(spark, tmp_path):
    sf = str(tmp_path / "sf")
    docs, toxic, run = corpus(spark, sf)
    now = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = now.columns, {}
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, now, sf)
        if k + 1 < len(cp.STAGES):
            assert out.columns == columns
        out.write.parquet(path := str(tmp_path / f"out{k}"))
        now = spark.read.parquet(path)
        kept[name] = {r.doc_id: r for r in now.collect()}
    everything = set(docs)
    assert set(kept["toxicity"]) == everything - toxic
    # document 304 equals 1 and is one long line: nothing of it is left
    assert set(kept["line dedup"]) == everything - toxic - {304}
    lines = kept["line dedup"]
    assert lines[301].text == docs[301] and run not in lines[302].text and lines[302].n_chars == len(lines[302].text)
    assert set(kept["SimHash near-dedup"]) == everything - toxic - {303, 304, 306}
    assert set(kept["benchmark decontamination"]) == everything - toxic - {300, 303, 304, 306}
    assert set(kept["best-fit packing"]) == set(kept["benchmark decontamination"])
    whole = {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in cp.run(spark, sf).collect()}
    assert whole == {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in now.collect()}


def test_empty_corpus(spark, tmp_path):
    sf = str(tmp_path / "sf")
    corpus(spark, sf)
    none = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        out = stage(spark, none, sf)
        assert out.count() == 0


def test_repeated_rows_and_clashing_columns(spark, tmp_path):
    from pyspark.sql import functions as F

    sf = str(tmp_path / "sf")
    corpus(spark, sf)
    base = spark.read.parquet(f"{sf}/documents.parquet")
    twice = base.unionByName(base.where("doc_id = 3")).select("*", *(F.lit(1).alias(c) for c in ("n_removed", "_gone", "score", "_gone_id", "_text_hash")))
    for name, stage in cp.STAGES[:4]:
        out = stage(spark, twice, sf)
        assert out.columns == twice.columns
    near = cp.near_stage(spark, twice, sf)
    assert near.where("doc_id = 3").count() == 1


def test_stages_take_rows_without_an_id_and_ties(spark, tmp_path):
    """Null ids, one id with two texts, repeated rows and a long text: each row is judged by its text."""
    sf = str(tmp_path / "sf")
    docs, _, _ = corpus(spark, sf)
    rng = random.Random(8)
    text = lambda n: " ".join(words_of(rng, n))
    item, lone, long_text = docs[300], text(60), text(30_000)
    now = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(None, docs[5]), (None, item), (None, lone), (None, lone), (7, lone + " " + text(1)), (7, long_text), (900, long_text), (900, long_text)]
    more = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], now.schema)
    now = now.where("doc_id < 300").unionByName(more)
    near = [(r.doc_id, r.text) for r in cp.near_stage(spark, now, sf).collect()]
    assert (None, docs[5]) not in near and (5, docs[5]) in near and (7, docs[7]) in near
    # of one class the row with the least id stays: 7 has another text than the one without an id
    assert (None, lone) not in near and sum(t == long_text for _, t in near) == 1 and (7, long_text) in near
    kept = [(r.doc_id, r.text) for r in cp.decontamination_stage(spark, now, sf).collect()]
    assert (None, item) not in kept and kept.count((None, lone)) == 2 and (5, docs[5]) in kept
    packed = cp.packing_stage(spark, now, sf).collect()
    assert sum(r.piece == 0 for r in packed) == now.count()
    lines = [(r.doc_id, r.text) for r in cp.line_stage(spark, now, sf).collect()]
    assert len(lines) <= now.count() and (5, docs[5]) in lines
    empty = now.limit(0)
    for _, stage in cp.STAGES[1:]:
        assert stage(spark, empty, sf).count() == 0
