"""Queries over utterances, sessions and responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import sessions as ss
from ..sources import audio
from .registry import ORACLES, query, table

SPACE = r"[\s\p{Z}\x{85}]"


def _joined(df: DataFrame, keys: list[str]) -> DataFrame:
    """Texts of a group in order, with a space between: a conversation's worth."""
    each = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return df.groupBy(*keys).agg(F.array_join(each, " ").alias("s"))


def _stats_sql(source: str, keys: str) -> str:
    zero = lambda f, v: f"coalesce({f}({v}), 0)"
    return f"""
with t as ({source}),
p as (select {keys}, string_split_regex(regexp_replace(s, '[^\\p{{L}}\\p{{N}}_.!?\\s\\p{{Z}}\\x{{85}}]', '', 'g'), '[.!?]') as parts from t),
w as (select {keys}, list_transform(parts, lambda x: list_filter(string_split_regex(x, '{SPACE}+'), lambda y: y <> '')) as ws from p),
v as (select {keys}, list_transform(flatten(ws), lambda x: length(x)) as lens, list_filter(list_transform(ws[1:len(ws) - 1], lambda x: len(x)), lambda x: x > 0) as ends from w)
select {keys}, cast(len(lens) as bigint) as word_count,
  round({zero('list_avg', 'lens')}, 6) as avg_word_len, cast({zero('list_min', 'lens')} as int) as min_word_len, cast({zero('list_max', 'lens')} as int) as max_word_len,
  round({zero('list_avg', 'ends')}, 6) as avg_words_per_sentence, cast({zero('list_min', 'ends')} as int) as min_words_per_sentence, cast({zero('list_max', 'ends')} as int) as max_words_per_sentence
from v"""


_SPEAKERS = "select conv_id, role, string_agg(text, ' ' order by turn) as s from conversations group by conv_id, role"


@query("speaker_stats", _stats_sql(_SPEAKERS, "conv_id, role"))
def speaker_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word and sentence metrics of each speaker of each conversation."""
    return _joined(table(spark, sf_dir, "conversations"), ["conv_id", "role"]).select("conv_id", "role", *tx.text_stats(F.col("s")))


@query("doc_text_stats", _stats_sql("select doc_id, text as s from documents", "doc_id"))
def doc_text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same metrics of every document; no shuffle."""
    return table(spark, sf_dir, "documents").select("doc_id", *tx.text_stats(F.col("text")))


@query(
    "speaker_report",
    f"""with r as ({_stats_sql(_SPEAKERS, "conv_id, role")})
select conv_id, string_agg(role || ': ' || word_count || ' words, ' || printf('%.1f', floor(avg_word_len * 10 + 0.5) / 10) || ' letters a word, ' || printf('%.2f', floor(avg_words_per_sentence * 100 + 0.5) / 100) || ' words a sentence', chr(10) order by role) as report
from r where word_count > 0 group by conv_id""",
)
def speaker_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report per conversation, a line per speaker who said anything."""
    stats = speaker_stats(spark, sf_dir).where("word_count > 0")
    line = tx.speaker_line(F.col("role"), F.col("word_count"), F.floor(F.col("avg_word_len") * 10 + 0.5) / 10, F.floor(F.col("avg_words_per_sentence") * 100 + 0.5) / 100)
    lines = F.transform(F.sort_array(F.collect_list(F.struct("role", line.alias("line")))), lambda x: x["line"])
    return stats.groupBy("conv_id").agg(F.array_join(lines, "\n").alias("report"))


@query(
    "utterance_log",
    f"""select conv_id, string_agg(role || ': ' || regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g'), chr(10) order by turn) as log, count(*) as n
from conversations where length(text) > 0 group by conv_id""",
)
def utterance_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled utterances of a conversation in order."""
    said = table(spark, sf_dir, "conversations").where(F.length("text") > 0).withColumn("line", F.concat_ws(": ", "role", tx.strip(F.col("text"))))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"])
    return said.groupBy("conv_id").agg(F.array_join(lines, "\n").alias("log"), F.count("*").alias("n"))


@query(
    "complete_turns",
    f"""select conv_id, turn, regexp_matches(regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g'), '[.!?]$') as complete from conversations""",
)
def complete_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does each utterance end in a sentence mark?"""
    segments = F.array(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.is_complete(segments).alias("complete"))


@query("chat_prompts", f"""select conv_id, cast(to_json([{{'role': 'system', 'content': 'Find the most poetic phrase.'}}, {{'role': 'user', 'content': log}}]) as varchar) as messages from ({ORACLES['utterance_log']})""")
def chat_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's log as a two-message prompt."""
    return utterance_log(spark, sf_dir).select("conv_id", tx.chat_prompt("Find the most poetic phrase.", F.col("log")).alias("messages"))


RESPONSES = [
    (1, "<|assistant|>The moon is beautiful."),
    (2, 'a <|assistant|> Most Poetic Phrase: "silver hush" \nIt glows.'),
    (3, "Most Poetic Phrase: 'quiet light' "),
    (4, 'It says "a b c" and "d".'),
    (5, 'only one " mark here'),
    (6, "<|assistant|>a<|assistant|> b "),
    (7, ""),
    (8, 'Most Poetic Phrase:\n  "\'nested\'"'),
]
_VALUES = ", ".join("({}, '{}')".format(i, r.replace("'", "''").replace("\n", "' || chr(10) || '")) for i, r in RESPONSES)


@query(
    "llm_response_parse",
    f"""with r(id, response) as (values {_VALUES}),
t as (select id, trim(string_split(response, '<|assistant|>')[-1], ' ' || chr(10)) as reply from r),
l as (select id, reply, contains(reply, 'Most Poetic Phrase:') as labelled, string_split(trim(substr(reply, strpos(reply, 'Most Poetic Phrase:') + 19), ' ' || chr(10)), chr(10))[1] as line from t)
select id, reply, case when labelled then trim(trim(trim(line), '"'), '''') when contains(reply, '"') then string_split(reply, '"')[2] end as phrase,
  'Legacy: ' || case when labelled then trim(trim(trim(line), '"'), '''') when contains(reply, '"') then string_split(reply, '"')[2] end as seed
from l""",
)
def llm_response_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reply, key phrase and seed of sample responses."""
    rows = spark.createDataFrame(RESPONSES, "id int, response string").withColumn("reply", tx.reply(F.col("response")))
    return rows.withColumn("phrase", tx.key_phrase(F.col("reply"))).select("id", "reply", "phrase", F.concat(F.lit("Legacy: "), F.col("phrase")).alias("seed"))


@query(
    "session_flush",
    """with recursive e as (
  select user_id as key, epoch(ts) as ats, least(value / 100, 5.0) as s, row_number() over (partition by user_id order by ts, event_id) as k from events
), r as (
  select key, k, ats as last, cast(null as double) as e1, cast(null as double) as e2, s as d from e where k = 1
  union all
  select key, k, last, e1, case when d > 15.0 then d end as e2, case when d > 15.0 then 0.0 else d end as d from (
    select e.key, e.k, e.ats as last, case when r.d > 1.0 and e.ats - r.last > 600.0 then r.d end as e1, case when r.d > 1.0 and e.ats - r.last > 600.0 then 0.0 else r.d end + e.s as d
    from r join e on e.key = r.key and e.k = r.k + 1)
), o as (
  select key, k, 1 as o, e1 as x from r where e1 is not null
  union all select key, k, 2, e2 from r where e2 is not null
  union all select key, k, 3, d from r where d > 1.0 and k = (select max(k) from e where e.key = r.key)
)
select key, row_number() over (partition by key order by k, o) - 1 as n, round(x, 6) as seconds from o""",
)
def session_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as chunks of up to five seconds, closed after ten minutes' pause or fifteen seconds."""
    chunks = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").cast("double").alias("at"), F.col("event_id").alias("id"), F.least(F.col("value") / 100, F.lit(5.0)).alias("seconds"))
    return ss.flushed(chunks, gap=600.0)


@query(
    "session_gaps",
    """with e as (select user_id, ts, event_id, case when epoch(ts) - lag(epoch(ts)) over (partition by user_id order by ts, event_id) > 43200 then 1 else 0 end as new from events),
s as (select user_id, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from e)
select user_id, cast(session as bigint) as session, count(*) as n from s group by 1, 2""",
)
def session_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user by session, twelve hours' pause apart."""
    at = F.col("ts").cast("timestamp").cast("double")
    return ss.gap_sessions(table(spark, sf_dir, "events"), "user_id", at, ["ts", "event_id"], 43200).groupBy("user_id", "session").agg(F.count("*").alias("n"))


@query(
    "count_trigger_windows",
    f"""with recursive t as (
  select conv_id as key, turn as ats, cast(len(list_filter(string_split_regex(text, '{SPACE}+'), lambda x: x <> '')) as bigint) as c, row_number() over (partition by conv_id order by turn) as k from conversations
), r as (
  select key, k, ats, c as tokens, cast(1 as bigint) as texts from t where k = 1
  union all
  select t.key, t.k, t.ats, case when r.tokens >= 100 then 0 else r.tokens end + t.c, case when r.tokens >= 100 then 0 else r.texts end + 1 from r join t on t.key = r.key and t.k = r.k + 1
)
select key, ats as last, tokens, texts from r where tokens >= 100""",
)
def count_trigger_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a conversation's turns that reach a hundred words."""
    tokens = F.size(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")).cast("long")
    return ss.token_windows(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("at"), tokens.alias("tokens")))


PATHS = ["/a/b.wav", "/a/C.WAV", "/a/notes.txt", "/a/d.flac", "/a/e.mp3.bak", "/a/f.aiff", "/a/g.ogg", "/a/wav"]


@query(
    "list_sources",
    "select regexp_extract(path, '[^/]*$') as file, path from (values " + ", ".join(f"('{p}')" for p in PATHS) + ") t(path) where regexp_matches(lower(path), '\\.(wav|mp3|m4a|flac|ogg|aiff)$')",
)
def list_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audio files among paths."""
    return audio.listed(spark.createDataFrame([(p,) for p in PATHS], "path string"))


@query("device_choice", "select coalesce(arg_min(n_name, n_nationkey) filter (contains(n_name, 'AN')), 'default') as chosen from nation")
def device_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first name that fits, or a default; nations stand in for devices."""
    return ss.first_match(table(spark, sf_dir, "nation"), "n_name", "AN", "default", "n_nationkey")


@query("guest_names", "select o_orderkey, coalesce(case when o_orderstatus = 'O' then o_orderstatus end, 'Guest-' || o_custkey) as speaker from orders")
def guest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named speakers, or a guest by number; orders stand in for streams."""
    named = F.when(F.col("o_orderstatus") == "O", F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.guest_name(named, F.col("o_custkey")).alias("speaker"))


@query("last_turns", "select conv_id, max(turn) as turn, max_by(text, turn) as text, count(distinct role) as speakers from conversations group by conv_id")
def last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last write wins by conversation, and its distinct speakers."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"), F.countDistinct("role").alias("speakers"))
