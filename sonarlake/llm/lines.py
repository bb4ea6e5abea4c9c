"""Line dedup by winnowing over line hashes, in DataFrame functions alone.

A window is the shortest run of lines from a line on that has ``LINES`` lines or
``WORDS`` space-separated words. Of each window the least line hash (the last
such line) is selected as a fingerprint: equal windows select equal fingerprints
at equal places, so a repeated run as long as a window always shares one. Windows
that follow each other mostly select the same line; each selected place is taken
once. Selected places are joined by their hash; around those met at two places or
more the match is extended to both sides, to all windows that selected the place
and, window by window, on to the ends of the run; a window is compared by a digest
of its lines with the first that has it, so there are no pairs of places. Every
window but the first of its text (by doc_id, null last, then line) is deleted, so of each
repeated run the first copy stays.

Defined results: a null text has no lines and stays null; a document shorter
than a window is left alone; rows that repeat an id and its text are one
document; a document that repeats itself loses its later runs; a document of
which nothing is left has an empty text; of documents without an id those of
equal texts are one. Extra columns stay with ``line_dedup(..., keep=...)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import fresh, materialise

LINES = 3
WORDS = 40


def windows(docs: DataFrame, lines: int = LINES, words: int = WORDS) -> DataFrame:
    """(doc_id, th, p, q, i, f, w, head): windows from line p to q, selected line i and its hash, the text's digest.

    ``head`` marks the first window that selects a place.
    """
    text = F.col("text")
    line = F.transform(F.split(text, "\n", -1), lambda x: F.struct(x.alias("s"), F.xxhash64(x).alias("h"), (1 + F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))).alias("n")))

    def window(x: Column, p: Column) -> Column:  # x: the line and those after it, null past the end
        at = [x[f"l{k}"] for k in range(lines)]
        rows = []
        for k in range(lines):
            run = at[: k + 1]
            joined = F.concat_ws("\n", *(v["s"] for v in run))
            # the least hash, of equal ones the last
            i, f = p, run[0]["h"]
            for j in range(1, k + 1):
                less = run[j]["h"] <= f
                i, f = F.when(less, p + j).otherwise(i), F.least(f, run[j]["h"])
            whole = F.struct(p.alias("p"), (p + k).alias("q"), i.cast("int").alias("i"), f.alias("f"), F.unhex(F.md5(joined)).alias("w"))
            rows.append((sum((v["n"] for v in run), F.lit(0)) >= words, F.when(run[-1].isNotNull(), whole)))
        out = rows[-1][1]
        for enough, whole in reversed(rows[:-1]):
            out = F.when(enough, whole).otherwise(out)
        return out

    def of(v: Column) -> Column:  # v is bound, so that it is made once a text and not once a line
        ahead = F.arrays_zip(*(F.slice(v, k + 1, F.size(v)).alias(f"l{k}") for k in range(lines)))
        return F.filter(F.transform(ahead, window), lambda x: x.isNotNull())

    def marked(v: Column) -> Column:
        return F.transform(v, lambda x, k: F.struct(*(x[c].alias(c) for c in "pqifw"), (~F.coalesce(F.get(v, k - 1)["i"] == x["i"], F.lit(False))).alias("head")))

    bound = F.get(F.transform(F.transform(F.array(line), of), marked), F.lit(0))
    return docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("th"), F.inline(bound))


def repeated(wins: DataFrame) -> DataFrame:
    """(doc_id, th, gone): the lines to delete in each document that has any; ``wins`` is stored."""
    last = F.col("doc_id").isNull().alias("last")
    at = F.struct(last, "doc_id", "th", "i")
    shared = wins.where("head").groupBy("f").agg(F.min(at).alias("a"), F.max(at).alias("b")).where("a <> b").select("f")
    near = wins.select("doc_id", "th", "p", "q", "f", "w").join(shared, "f", "left_semi")
    place = F.struct(last, "doc_id", "th", "p")
    first = near.groupBy("w").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("w", "a")
    later = near.join(first, "w").where(place > F.col("a"))
    return later.groupBy("doc_id", "th").agg(F.array_distinct(F.flatten(F.collect_set(F.expr("sequence(p, q)")))).alias("gone"))


def kept(text: Column, gone: Column) -> Column:
    """The text without the lines whose numbers are in ``gone``."""
    s = F.split(text, "\n", -1)
    both = F.struct(s.alias("s"), F.array_except(F.sequence(F.lit(0), F.size(s) - 1), gone).alias("stay"))
    # bound in an array of one, so that the text is split once and not once a line
    joined = F.transform(F.array(both), lambda v: F.array_join(F.transform(v["stay"], lambda i: F.get(v["s"], i)), "\n"))
    return F.when(gone.isNull(), text).otherwise(F.get(joined, F.lit(0)))


def line_dedup(docs: DataFrame, keep: list[str] | None = None, lines: int = LINES, words: int = WORDS) -> DataFrame:
    """``docs`` with ``text`` rid of repeated runs, and n_lines, n_removed (underscored if taken)."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gone = materialise(repeated(materialise(windows(src, lines, words), "line-windows")), "line-gone")
    cols = [c for c in (docs.columns if keep is None else keep) if c not in ("doc_id", "text")]
    i, th, g = (fresh(x, cols) for x in ("_id", "_th", "_gone"))
    gone = gone.toDF(i, th, g)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(docs[c] for c in cols))
    # hashed by document at every size; the lists to delete grow with the input, so they aren't broadcast
    both = src.join(gone.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(th)), "left")
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    return both.select("doc_id", kept(F.col("text"), F.col(g)).alias("text"), *cols, n.cast("long").alias(fresh("n_lines", cols)), F.coalesce(F.size(g), F.lit(0)).cast("long").alias(fresh("n_removed", cols)))


def op7_winnow_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text rid of line runs that came before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_dedup(docs, keep=[]).select("doc_id", "n_lines", "n_removed", "text")


ORACLE_SQL = f"""
with l as (
  select doc_id, u.i - 1 as p, s[u.i] as line, 1 + length(s[u.i]) - length(replace(s[u.i], ' ', '')) as n, len(s) as total
  from (select doc_id, string_split(text, chr(10)) as s from documents where text is not null) d,
       lateral (select unnest(range(1, len(s) + 1)) as i) u
), a as (
  select *, lead(line, 1) over o as line1, lead(line, 2) over o as line2, lead(n, 1) over o as n1
  from l window o as (partition by doc_id order by p)
), b as (
  select *, case when n >= {WORDS} then p when n + n1 >= {WORDS} then p + 1 else p + 2 end as q from a
), w as (
  select doc_id, p, q, case q - p when 0 then line when 1 then line || chr(10) || line1 else line || chr(10) || line1 || chr(10) || line2 end as content
  from b where q < total
), r as (
  select *, row_number() over (partition by content order by doc_id, p) as k from w
), g as (
  select distinct doc_id, unnest(range(p, q + 1)) as p from r where k > 1
), t as (
  select l.doc_id, count(*) as n_lines, count(g.p) as n_removed,
         coalesce(string_agg(l.line, chr(10) order by l.p) filter (where g.p is null), '') as text
  from l left join g on g.doc_id = l.doc_id and g.p = l.p group by l.doc_id
)
select d.doc_id, coalesce(t.n_lines, 0) as n_lines, coalesce(t.n_removed, 0) as n_removed, t.text
from documents d left join t using (doc_id)
"""
