"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all
that the stage before kept, and its decisions take effect. All but the last
return the columns of ``docs``. What a stage writes on its way is deleted when
the next one begins, by when its result has been written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarlake.llm.decontaminate import found_leaks
from sonarlake.llm.lines import line_dedup
from sonarlake.llm.neardup import classes
from sonarlake.llm.packing import pack_documents
from sonarlake.llm.store import fresh, materialise, release, scoped, small_batches
from sonarlake.llm.toxicity import labelled_sample, train, without_toxic

ORACLE_SQL = None


def _without(docs: DataFrame, ids: DataFrame, label: str) -> DataFrame:
    """``docs`` but for those in ``ids`` (doc_id); a small table of ids is broadcast by its size on disk."""
    gone = fresh("_gone_id", docs.columns)
    stored = materialise(ids.select(F.col("doc_id").alias(gone)).where(F.col(gone).isNotNull()).distinct(), label)
    return docs.join(stored, docs["doc_id"] == stored[gone], "left_anti")


def _without_texts(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` but for the rows of an id, null or not, and a text's hash in ``gone`` (doc_id, node)."""
    i, h = fresh("_odd_id", docs.columns), fresh("_odd_text", docs.columns)
    gone = gone.select(F.col("doc_id").alias(i), F.col("node").alias(h)).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone[i]) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == gone[h]), "left_anti")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; a null or empty text stays."""
    small_batches(spark)
    release(spark, "pipeline")
    with scoped("pipeline"):
        return without_toxic(docs, train(labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines go; so does a document of which nothing is left. ``n_chars`` follows the text."""
    release(spark, "pipeline")
    with scoped("pipeline"):
        out = line_dedup(docs)
        n = fresh("n_removed", docs.columns)
        out = out.where((F.col(n) == 0) | (F.col("text") != ""))
        if "n_chars" in docs.columns:
            out = out.withColumn("n_chars", F.when(F.col(n) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
        return out.select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the one of least id; rows that repeat an id and a text count once.

    Null ids come last in a class, and rows of one id with other texts are judged by their texts.
    """
    release(spark, "pipeline")
    with scoped("pipeline"):
        found = materialise(classes(docs).select("doc_id", "node", "is_kept"), "near-found")
        per = found.groupBy("doc_id").agg(F.bool_or("is_kept").alias("some"), F.bool_and("is_kept").alias("all"), F.count("*").alias("c"))
        out = _without(docs, per.where("not some"), "near-gone")
        # ids of which one text stays and another goes (no id at all is one of these): by id and text
        odd = per.where("not all and (some or doc_id is null)").select("doc_id")
        if not odd.isEmpty():
            gone = found.join(odd.withColumnRenamed("doc_id", "odd"), F.col("doc_id").eqNullSafe(F.col("odd"))).where("not is_kept")
            out = _without_texts(out, gone)
        if per.where("c > 1").isEmpty():
            return out
        t = fresh("_text_hash", docs.columns)
        return out.withColumn(t, F.xxhash64("text")).dropDuplicates(["doc_id", t]).drop(t)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or a paraphrase of one, go; null and empty texts stay; a row without an id is judged by its text."""
    release(spark, "pipeline")
    with scoped("pipeline"):
        found = materialise(found_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "row"), "leak-found")
        out = _without(docs, found, "leak-gone")
        # the row of no id is the hash of its text's hash alone
        lost = found.where("doc_id is null").select("row").distinct()
        if lost.isEmpty():
            return out
        h = F.xxhash64(F.xxhash64(out["text"].cast("string")))
        return out.join(lost, out["doc_id"].isNull() & (h == lost["row"]), "left_anti")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of what is left; a null or empty text is a closing id, and repeated rows are packed as often as they come."""
    release(spark, "pipeline")
    with scoped("pipeline"):
        return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            with scoped(f"pipeline-docs-{k % 2}"):
                docs = materialise(docs, "pipeline-docs")
            release(spark, f"pipeline-docs-{(k + 1) % 2}")
    return docs
