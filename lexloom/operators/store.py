"""Entity, event and record stores as queries over append-only logs; queues and incremental upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def entity_latest(log: DataFrame) -> DataFrame:
    """One row per entity: the latest row's values, the earliest creation and first artifact, the last artifact.

    Rows without an id drop out; ties by the greatest name.
    """
    keyed = log.where(F.col("entity_id").isNotNull())
    new = F.max(F.struct("updated_at", "name", "entity_type", "aliases", F.col("provenance.last_seen_artifact_id").alias("last_seen"))).alias("n")
    old = F.min(F.struct("created_at", F.col("provenance.first_seen_artifact_id").alias("first_seen"))).alias("o")
    return keyed.groupBy("entity_id").agg(new, old, F.count("*").alias("n_rows")).select("entity_id", "n.name", "n.entity_type", "n.aliases", "o.created_at", "n.updated_at", F.col("o.first_seen").alias("first_seen"), F.col("n.last_seen").alias("last_seen"), "n_rows")


def timelines(events: DataFrame, entity: str, event_id: str, at: str, kind: str, most: int = 200, issue: str = "issue", resolution: str = "resolution") -> DataFrame:
    """(entity, n_events, status, timeline): the last ``most`` events of each entity in order, and its status.

    The status is ``active`` where the last issue has no later resolution,
    else ``unknown``.  Rows beyond the last ``most`` are cut before anything is
    gathered, so an entity with any number of events makes a bounded list.
    """
    last = F.max(F.when(F.col(kind).isin(issue, resolution), F.struct(at, event_id, F.col(kind).alias("k"))))
    figures = events.groupBy(entity).agg(F.count("*").alias("n_events"), last["k"].alias("_last"))
    recent = events.withColumn("_r", F.row_number().over(W.partitionBy(entity).orderBy(F.desc(at), F.desc(event_id)))).where(F.col("_r") <= most)
    lists = recent.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(event_id).alias("id"), F.col(kind).alias("kind")))).alias("timeline"))
    return lists.join(figures, entity).select(entity, "n_events", F.when(F.col("_last") == issue, "active").otherwise("unknown").alias("status"), "timeline")


def linked_artifacts(entities: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(artifact_id, doc_id, n_entities): artifacts that entities were seen in first or last, with their document (null where unknown)."""
    seen = entities.select("entity_id", F.explode(F.array_distinct(F.array("provenance.first_seen_artifact_id", "provenance.last_seen_artifact_id"))).alias("artifact_id")).where(F.col("artifact_id").isNotNull())
    counted = seen.distinct().groupBy("artifact_id").agg(F.count("*").alias("n_entities"))
    of = artifacts.groupBy("artifact_id").agg(F.min("doc_id").alias("doc_id"))
    return counted.join(of, "artifact_id", "left").select("artifact_id", "doc_id", "n_entities")


def new_rows(incoming: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key is not known yet; a null key is never known."""
    return incoming.join(known.select(key).distinct(), key, "left_anti")


def gone_rows(index: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Index rows whose key is no longer in the current input."""
    return index.join(current.select(key).distinct(), key, "left_anti")


def pending(queue: DataFrame, done: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Queue rows without a result, the oldest first."""
    left = queue.join(done.select(key).distinct(), key, "left_anti").orderBy(key)
    return left.limit(limit) if limit else left


def with_status(queue: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Queue rows with the status of their latest result (key, at, ok): PENDING, DONE or FAILED."""
    last = results.groupBy(key).agg(F.max(F.struct("at", "ok")).alias("_l"))
    return queue.join(last, key, "left").withColumn("status", F.when(F.col("_l").isNull(), "PENDING").when(F.col("_l.ok"), "DONE").otherwise("FAILED")).drop("_l")


def category_overlay(log: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, manual, auto): the categories in force of an append-only log (key, at, category, by 'manual' or 'auto').

    Of each kind the last row of a key counts (ties by the greatest category);
    a null category takes an earlier one back.
    """
    pick = lambda by: F.max(F.when(F.col("by") == by, F.struct("at", F.coalesce("category", F.lit("")).alias("category"))))["category"]
    clear = lambda c: F.when(F.col(c) != "", F.col(c))
    return log.where(F.col(key).isNotNull()).groupBy(key).agg(pick("manual").alias("manual"), pick("auto").alias("auto")).select(key, clear("manual").alias("manual"), clear("auto").alias("auto"))


def edit_categories(categories: DataFrame, log: DataFrame, fixed: str = "기타") -> DataFrame:
    """(name): the list of categories after a log (name, at, op 'add' or 'remove'); the last operation on a name counts, and ``fixed`` can't be removed."""
    last = log.where(F.col("name").isNotNull()).groupBy("name").agg(F.max(F.struct("at", "op"))["op"].alias("op"))
    names = categories.select("name").union(last.where("op = 'add'").select("name")).distinct()
    return names.join(last.where((F.col("op") == "remove") & (F.col("name") != fixed)).select("name"), "name", "left_anti")
