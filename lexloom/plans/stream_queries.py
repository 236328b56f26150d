"""Streams over whole tables, run until their input is read."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from lexloom.functions.constants import DENY_PHRASES
from lexloom.operators.classify import follow_ups, is_meaningful
from lexloom.operators.store import with_status
from lexloom.plans.tagging_queries import _TRIMMED
from lexloom.plans.text_queries import TAGGING_SQL
from lexloom.session import table
from lexloom.streaming import ingest as I


def _stream(spark, d, name, *cols):
    path = os.path.join(d, f"{name}.parquet")
    schema = spark.read.parquet(path).select(*cols).schema
    reader = spark.readStream.schema(schema)
    if os.path.isfile(path):  # a stream reads folders; a table that is one file is named by a filter
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(d)
    return reader.parquet(path)


def stream_df_state(spark, d):
    """Document frequencies kept by a stream of corpus records, each record once."""
    work = I.work_dir(spark, "df-state")
    I.run_df_state(_stream(spark, d, "corpus", "doc_id", "text").where("doc_id IS NOT NULL"), f"{work}/state", f"{work}/checkpoint")
    return I.read_df_state(spark, f"{work}/state")


def stream_new_questions(spark, d):
    """Answer lengths of the question log, each entry once, as a stream that works a queue."""
    work = I.work_dir(spark, "queue")
    stream = _stream(spark, d, "qna_log", "entry_id", "question").where("entry_id IS NOT NULL")
    I.work_queue(stream, lambda q: F.upper(F.trim(q)), f"{work}/results", f"{work}/checkpoint")
    return spark.read.parquet(f"{work}/results").groupBy("ok").agg(F.count("*").alias("n"), F.sum(F.length("answer")).alias("chars"))


def stream_feedback_windows(spark, d):
    """Votes by day, as the stream's window aggregation gives them over the whole log."""
    kind = F.when(F.col("event_type").isin("click", "purchase"), "like").when(F.col("event_type") == "error", "dislike")
    votes = table(spark, d, "events").select("ts", kind.alias("feedback")).where(F.col("feedback").isNotNull())
    return I.windowed_feedback(votes).select(F.unix_timestamp("start").alias("start_s"), "feedback", "n")


def stream_entity_status(spark, d):
    """Status of every subject after a stream of its events, from the last state that the stream gave out."""
    work = I.work_dir(spark, "status")
    events = _stream(spark, d, "events", "user_id", "ts", "event_type", "event_id").where("user_id IS NOT NULL")
    I.run_to_files(I.entity_status(events, "user_id", "ts", "event_type", "error", "purchase", "event_id"), f"{work}/status", f"{work}/checkpoint")
    last = spark.read.parquet(f"{work}/status").groupBy("entity").agg(F.max(F.struct("n_events", "status")).alias("l"))
    return last.select(F.col("entity").cast("bigint").alias("user_id"), "l.status", "l.n_events")


def stream_question_status(spark, d):
    """The question log worked off as a queue: entries by status, done where the answer says something, failed where not, pending where the portal gave no verdict yet."""
    work = I.work_dir(spark, "status")
    stream = _stream(spark, d, "qna_log", "entry_id", "portal_answer_snippet", "has_answer").where("entry_id IS NOT NULL AND has_answer IS NOT NULL")
    lines = lambda a: F.when(is_meaningful(a), F.array_join(follow_ups(a), "|"))
    I.work_queue(stream, lines, f"{work}/results", f"{work}/checkpoint", text="portal_answer_snippet")
    results = spark.read.parquet(f"{work}/results").select("entry_id", F.lit(0).alias("at"), "ok")
    queue = table(spark, d, "qna_log").select("entry_id").where("entry_id IS NOT NULL").distinct()
    return with_status(queue, results, "entry_id").groupBy("status").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (stream_df_state, stream_new_questions, stream_feedback_windows, stream_entity_status, stream_question_status)}

ORACLE = {
    "stream_df_state": f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TAGGING_SQL.format('text')}) AS term FROM (SELECT doc_id, any_value(text) AS text FROM corpus WHERE doc_id IS NOT NULL GROUP BY 1)) GROUP BY 1",
    "stream_new_questions": "SELECT coalesce(length(trim(q)) > 0, false) AS ok, count(*) AS n, sum(length(trim(q)))::BIGINT AS chars FROM (SELECT entry_id, any_value(question) AS q FROM qna_log WHERE entry_id IS NOT NULL GROUP BY 1) GROUP BY 1",
    "stream_question_status": f"""
        WITH q AS (SELECT entry_id, any_value(a) AS a, max(has_answer) AS h FROM (SELECT entry_id, {_TRIMMED.format('portal_answer_snippet')} AS a, has_answer FROM qna_log WHERE entry_id IS NOT NULL) GROUP BY 1)
        SELECT CASE WHEN h IS NULL THEN 'PENDING' WHEN coalesce(length(a) >= 20 AND NOT ({' OR '.join(f"contains(a, '{p}')" for p in DENY_PHRASES)}), false) THEN 'DONE' ELSE 'FAILED' END AS status, count(*) AS n FROM q GROUP BY 1""",
    "stream_feedback_windows": "SELECT floor(epoch(date_trunc('day', ts)))::BIGINT AS start_s, CASE WHEN event_type = 'error' THEN 'dislike' ELSE 'like' END AS feedback, count(*) AS n FROM events WHERE ts IS NOT NULL AND event_type IN ('click', 'purchase', 'error') GROUP BY 1, 2",
    "stream_entity_status": "SELECT user_id, CASE WHEN arg_max(event_type, (ts, event_id)) FILTER (event_type IN ('error', 'purchase') AND ts IS NOT NULL) = 'error' THEN 'active' ELSE 'unknown' END AS status, count(*) AS n_events FROM events WHERE user_id IS NOT NULL GROUP BY 1",
}
