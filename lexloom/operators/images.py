"""Image queue, labels and their merge; an image is a row of a table, its pixels are never read here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import normalize_tag


def register(queue: DataFrame, found: DataFrame) -> DataFrame:
    """The queue with those found images that it lacks, unlabelled; an id found twice is queued once."""
    fresh = found.join(queue.select("image_id"), "image_id", "left_anti").dropDuplicates(["image_id"])
    return queue.unionByName(fresh, allowMissingColumns=True)


def latest_labels(history: DataFrame) -> DataFrame:
    """The last label of each image in an append-only history (image_id, at, ...); ties by the greatest values."""
    rest = [c for c in history.columns if c not in ("image_id", "at")]
    best = F.max(F.struct("at", *rest)).alias("_b")
    return history.where(F.col("image_id").isNotNull()).groupBy("image_id").agg(best).select("image_id", "_b.*")


def merge_labels(queue: DataFrame, history: DataFrame) -> DataFrame:
    """The queue with each image's last label and whether it is labelled or ignored; an ignored label counts as handled."""
    last = latest_labels(history).withColumnRenamed("at", "labeled_at")
    joined = queue.join(last, "image_id", "left")
    return joined.withColumn("ignored", F.coalesce("ignored", F.lit(False))).withColumn("labeled", F.col("labeled_at").isNotNull() & ~F.col("ignored"))


def counters(items: DataFrame, parent: str, labeled: Column, present: Column) -> DataFrame:
    """(parent, total, unlabeled, missing) of items by their document."""
    return items.groupBy(parent).agg(F.count("*").alias("total"), F.sum((~F.coalesce(labeled, F.lit(False))).cast("int")).alias("unlabeled"), F.sum((~F.coalesce(present, F.lit(False))).cast("int")).alias("missing"))


def tag_union(items: DataFrame, parent: str, tag: Column) -> DataFrame:
    """(parent, tags): distinct normalised tags of a document's items, sorted; blank ones are left out."""
    tags = items.select(parent, normalize_tag(tag).alias("_t")).where("_t <> ''").distinct()
    return tags.groupBy(parent).agg(F.array_sort(F.collect_set("_t")).alias("tags"))


def work_order(queue: DataFrame) -> DataFrame:
    """Unlabelled images first, then by id."""
    return queue.orderBy(F.coalesce("labeled", F.lit(False)), "image_id")


def payload_with_queue(payload: DataFrame, queue: DataFrame, key: str = "image_id", doc: str = "doc_id", parent: str = "parent_doc_id") -> DataFrame:
    """(doc, n_payload, n_queued, n_both): images by document, whether the payload, the queue or both have them.

    A full outer join on the image; the document is the payload's, else the
    queue's.  Images without an id belong to neither.
    """
    ours = payload.where(F.col(key).isNotNull()).select(key, F.col(doc).alias("_d")).groupBy(key).agg(F.min("_d").alias("_d")).withColumn("_p", F.lit(1))
    theirs = queue.where(F.col(key).isNotNull()).select(key, F.col(parent).alias("_e")).groupBy(key).agg(F.min("_e").alias("_e")).withColumn("_q", F.lit(1))
    both = ours.join(theirs, key, "full_outer")
    n = lambda c: F.count(c)
    return both.groupBy(F.coalesce("_d", "_e").alias(doc)).agg(n("_p").alias("n_payload"), n("_q").alias("n_queued"), F.count_if(F.col("_p").isNotNull() & F.col("_q").isNotNull()).alias("n_both"))
