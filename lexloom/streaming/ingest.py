"""Structured Streaming counterparts of the append-only logs and states."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexloom.functions.text import tagging_tokens
from lexloom.sources.sinks import partition_append


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder that the cluster names; only a local session may do without, with a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lexloom-")
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def new_documents(stream: DataFrame, key: str = "doc_id", at: str | None = None, late: str = "1 day") -> DataFrame:
    """Rows whose key has not come before; with ``at`` keys are forgotten once ``late`` has passed, so the state stays bounded."""
    if at is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def df_deltas(batch: DataFrame, text: str = "text") -> DataFrame:
    """(term, df) of one batch of new documents."""
    return batch.select(F.explode(F.array_distinct(tagging_tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def run_df_state(stream: DataFrame, path: str, checkpoint: str, key: str = "doc_id", text: str = "text") -> None:
    """Keeps document frequencies of a stream of documents as one delta per batch; runs until the input that is there is read.

    Documents that come again are left out by the stream's state; a batch
    tried again overwrites its own delta.
    """

    def save(batch: DataFrame, number: int) -> None:
        partition_append(df_deltas(batch, text), path, number)

    query = new_documents(stream.select(key, text), key).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def read_df_state(spark: SparkSession, path: str) -> DataFrame:
    """(term, df) summed up over the deltas."""
    return spark.read.parquet(path).groupBy("term").agg(F.sum("df").alias("df"))


def windowed_feedback(stream: DataFrame, at: str = "ts", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, feedback, n): votes by tumbling window; votes later than ``late`` are dropped."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), "feedback").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "feedback", "n")


def entity_status(stream: DataFrame, entity: str, at: str, kind: str, issue: str = "issue", resolution: str = "resolution", event_id: str | None = None) -> DataFrame:
    """(entity, status, n_events) whenever new events of an entity come: active after an issue, unknown after a resolution.

    Custom state: the latest deciding event by time and, where ``event_id``
    names a whole number, by id, and a counter per entity, so events may come
    in any order within and across batches.
    """

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at_us, number, active, n = state.get if state.exists else (-(1 << 62), -(1 << 62), False, 0)
        for f in frames:
            n += len(f)
            deciding = f[f["kind"].isin([issue, resolution]) & f["us"].notna()]
            for us, i, what in zip(deciding["us"], deciding["id"], deciding["kind"]):
                if (us, i) >= (at_us, number):
                    at_us, number, active = int(us), int(i), what == issue
        state.update((at_us, number, active, n))
        yield pd.DataFrame({"entity": [k[0]], "status": ["active" if active else "unknown"], "n_events": [n]})

    src = stream.select(F.col(entity).cast("string").alias("entity"), F.unix_micros(F.col(at).cast("timestamp")).alias("us"), (F.coalesce(F.col(event_id).cast("bigint"), F.lit(0)) if event_id else F.lit(0).cast("bigint")).alias("id"), F.col(kind).alias("kind"))
    return src.groupBy("entity").applyInPandasWithState(fold, "entity string, status string, n_events bigint", "at bigint, number bigint, active boolean, n bigint", "update", GroupStateTimeout.NoTimeout)


def run_to_files(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> None:
    """Writes the results of a stream, a partition for each batch, until the input that is there is read."""
    query = stream.writeStream.outputMode(mode).foreachBatch(lambda batch, number: partition_append(batch, path, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def work_queue(stream: DataFrame, answer, path: str, checkpoint: str, key: str = "entry_id", text: str = "question") -> None:
    """Answers queued questions with ``answer``, a column function (an injected UDF), and writes results with their status per batch."""

    def save(batch: DataFrame, number: int) -> None:
        done = batch.select(key, answer(F.col(text)).alias("answer")).withColumn("ok", F.coalesce(F.length("answer") > 0, F.lit(False)))
        partition_append(done, path, number)

    query = new_documents(stream.select(key, text), key).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
