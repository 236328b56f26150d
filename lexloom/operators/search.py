"""Tag index, document index, staged and full search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions.constants import SEARCH_WEIGHTS


def tag_index(tags: DataFrame) -> DataFrame:
    """(tag, doc_id, tag_score, from_topic): inverted index of (doc_id, tag, score, from_topic), lower case; of repeated tags the best score stays."""
    return tags.groupBy(F.lower("tag").alias("tag"), "doc_id").agg(F.max("score").alias("tag_score"), F.max("from_topic").alias("from_topic"))


def document_index(docs: DataFrame, tags: DataFrame) -> DataFrame:
    """(doc_id, title, genre, topic, tags): one row per document with its tags in order of rank; documents without tags have []."""
    lists = tags.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag"))), lambda x: x["tag"]).alias("tags"))
    return docs.join(lists, "doc_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def update_index(index: DataFrame, fresh: DataFrame, deleted: DataFrame) -> DataFrame:
    """The index without deleted documents, and with the entries of documents ingested anew in place of their old ones; equal to a rebuild."""
    gone = deleted.select("doc_id").union(fresh.select("doc_id")).distinct()
    return index.join(gone, "doc_id", "left_anti").unionByName(fresh)


def _any(words: list[str], test) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | test(w)
    return out


def stage1(index: DataFrame, query: str, genres: DataFrame | None = None, genre: str | None = None, top: int = 100) -> DataFrame:
    """(doc_id, score): the ``top`` documents by matching tags; a tag counts its score, 1.5 times from the topic, twice when equal to the query and 1.5 times when one holds the other.

    The query is folded into the plan as literals, so the index is only
    filtered and summed up by document.
    """
    low = query.lower()
    words = list(dict.fromkeys(low.split()))
    parts = F.filter(F.split("tag", " "), lambda t: t != "")
    matched = _any(words, lambda w: F.col("tag").contains(w)) | F.exists(parts, lambda t: F.lit(low).contains(t))
    kind = F.when(F.col("tag") == low, 2.0).when(F.col("tag").contains(low) | F.lit(low).contains(F.col("tag")), 1.5).otherwise(1.0)
    part = F.col("tag_score") * F.when(F.col("from_topic"), 1.5).otherwise(1.0) * kind
    scored = index.where(matched).groupBy("doc_id").agg(F.round(F.sum(part), 6).alias("score"))
    if genre is not None and genres is not None:
        scored = scored.join(genres.where(F.col("genre") == genre).select("doc_id"), "doc_id", "left_semi")
    return scored.orderBy(F.desc("score"), "doc_id").limit(top)


def _grams(text: Column) -> Column:
    """Distinct single characters and pairs of neighbours: whatever a text holds begins with one of them."""
    n = F.length(text)
    one = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(text, i, F.lit(1)))
    two = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(text, i, F.lit(2)))
    return F.when(n > 0, F.array_distinct(F.concat(one, two))).otherwise(F.array().cast("array<string>"))


def _query_words(queries: DataFrame) -> DataFrame:
    """(qid, low, words): queries in lower case with their distinct words; blank ones are left out."""
    low = queries.select("qid", F.lower("query").alias("low"))
    return low.withColumn("words", F.array_distinct(F.filter(F.split("low", r"\s+"), lambda w: w != ""))).where(F.size("words") > 0)


def stage1_many(index: DataFrame, queries: DataFrame, top: int = 100) -> DataFrame:
    """(qid, doc_id, score, rank): :func:`stage1` for a table of queries (qid, query).

    Distinct tags and queries meet in a hash join on the first two characters
    of what one must hold of the other, and only those pairs are tested; the
    index is joined once with the tags that any query matches.
    """
    q = _query_words(queries)
    tags = index.select("tag").distinct()
    words = q.select("qid", "low", F.explode("words").alias("w")).withColumn("_g", F.substring("w", 1, 2))
    by_word = words.join(tags.select("tag", F.explode(_grams(F.col("tag"))).alias("_g")), "_g").where(F.contains("tag", "w")).select("qid", "low", "tag")
    tokens = tags.select("tag", F.explode(F.filter(F.split("tag", " "), lambda t: t != "")).alias("t")).withColumn("_g", F.substring("t", 1, 2))
    by_token = tokens.join(q.select("qid", "low", F.explode(_grams(F.col("low"))).alias("_g")), "_g").where(F.contains("low", "t")).select("qid", "low", "tag")
    kind = F.when(F.col("tag") == F.col("low"), 2.0).when(F.contains("tag", "low") | F.contains("low", "tag"), 1.5).otherwise(1.0)
    matched = by_word.unionByName(by_token).distinct().select("qid", "tag", kind.alias("_k"))
    part = F.col("tag_score") * F.when(F.col("from_topic"), 1.5).otherwise(1.0) * F.col("_k")
    scored = index.join(matched, "tag").groupBy("qid", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top)


def search_many(docs: DataFrame, index: DataFrame, queries: DataFrame, boosts: DataFrame | None = None, top: int = 100, limit: int = 20) -> DataFrame:
    """(qid, doc_id, base_score, feedback_boost, score, reasons, rank): both stages for a table of queries (qid, query); points as in :func:`stage2`."""
    q = _query_words(queries)
    first = stage1_many(index, queries, top).select("qid", "doc_id")
    j = docs.join(first, "doc_id").join(q, "qid")
    topic, title, text = (F.lower(F.coalesce(c, F.lit(""))) for c in ("topic", "title", "text"))
    low = F.col("low")
    some = lambda c: F.exists("words", lambda w: F.contains(c, w))
    tag = lambda t: F.when(F.lower(t) == low, 20.0).when(F.contains(F.lower(t), low) | F.contains(low, F.lower(t)), 10.0).when(F.exists("words", lambda w: F.contains(F.lower(t), w)), 5.0).otherwise(0.0)
    of_topic = F.when(F.contains(topic, low), 100.0).when(some(topic), 50.0).otherwise(0.0)
    of_title = F.when(F.contains(title, low), 30.0).when(some(title), 15.0).otherwise(0.0)
    of_tags = F.aggregate(F.transform("tags", tag), F.lit(0.0), lambda a, x: a + x)
    weight = F.lit(1.0)
    for g, by in SEARCH_WEIGHTS.items():
        weight = F.when(F.col("genre") == g, F.coalesce(*[F.when(low.contains(k), float(v)) for k, v in by.items()], F.lit(1.0))).otherwise(weight)
    points = j.select("qid", "doc_id", of_topic.alias("p"), of_title.alias("t"), of_tags.alias("g"), F.contains(text, low).alias("whole"), some(text).alias("some"), weight.alias("w")).where("p + t + g > 0")
    base = (F.col("p") + F.col("t") + F.col("g") + F.when(F.col("whole"), 5.0).when(F.col("some"), 1.0).otherwise(0.0)) * F.col("w")
    scored = points.select("qid", "doc_id", base.alias("_b"), F.array_join(_reasons(), ",").alias("reasons"))
    if boosts is not None:
        scored = scored.join(boosts.select("doc_id", F.col("boost").alias("feedback_boost")), "doc_id", "left")
    else:
        scored = scored.withColumn("feedback_boost", F.lit(1.0))
    boosted = scored.withColumn("feedback_boost", F.coalesce("feedback_boost", F.lit(1.0))).withColumn("score", F.round(F.col("_b") * F.col("feedback_boost"), 2))
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "doc_id"))
    return boosted.withColumn("rank", rank).where(F.col("rank") <= limit).select("qid", "doc_id", F.round("_b", 2).alias("base_score"), "feedback_boost", "score", "reasons", "rank")


def _reasons() -> Column:
    parts = (F.when(F.col("p") == 100, "topic").when(F.col("p") == 50, "topic part"), F.when(F.col("t") == 30, "title").when(F.col("t") == 15, "title part"), F.when(F.col("g") > 0, "tags"), F.when(F.col("whole"), "text"))
    return F.filter(F.array(*parts), lambda r: r.isNotNull())


def query_weight(genre: Column, query: str) -> Column:
    """Weight of a document's genre for a query: that of the first of the genre's words in it, 1.0 for none."""
    low, out = query.lower(), F.lit(1.0)
    for g, words in SEARCH_WEIGHTS.items():
        w = next((v for k, v in words.items() if k in low), None)
        if w is not None:
            out = F.when(genre == g, w).otherwise(out)
    return out


def stage2(docs: DataFrame, query: str, boosts: DataFrame | None = None, limit: int = 20, tag_points: Column | None = None) -> DataFrame:
    """(doc_id, base_score, feedback_boost, score, reasons): documents by detailed score.

    ``docs``: (doc_id, title, genre, topic, tags, text).  Topic 100 or 50,
    title 30 or 15, each tag 20, 10 or 5, and text 5 or 1 where anything else
    scored; times the genre's weight for the query and the feedback boost.
    Documents that score 0 are left out.
    """
    low = query.lower()
    words = list(dict.fromkeys(low.split()))
    topic, title, text = (F.lower(F.coalesce(c, F.lit(""))) for c in ("topic", "title", "text"))
    has = lambda c: _any(words, lambda w: c.contains(w))
    tag = lambda t: F.when(F.lower(t) == low, 20.0).when(F.lower(t).contains(low) | F.lit(low).contains(F.lower(t)), 10.0).when(_any(words, lambda w: F.lower(t).contains(w)), 5.0).otherwise(0.0)
    of_topic = F.when(topic.contains(low), 100.0).when(has(topic), 50.0).otherwise(0.0)
    of_title = F.when(title.contains(low), 30.0).when(has(title), 15.0).otherwise(0.0)
    of_tags = tag_points if tag_points is not None else F.aggregate(F.transform("tags", tag), F.lit(0.0), lambda a, x: a + x)
    first = docs.select("doc_id", "genre", of_topic.alias("p"), of_title.alias("t"), of_tags.alias("g"), text.contains(low).alias("whole"), has(text).alias("some")).where("p + t + g > 0")
    body = F.when(F.col("whole"), 5.0).when(F.col("some"), 1.0).otherwise(0.0)
    base = (F.col("p") + F.col("t") + F.col("g") + body) * query_weight(F.col("genre"), query)
    scored = first.select("doc_id", F.round(base, 2).alias("base_score"), base.alias("_b"), F.array_join(_reasons(), ",").alias("reasons"))
    if boosts is not None:
        scored = scored.join(boosts.select("doc_id", F.col("boost").alias("feedback_boost")), "doc_id", "left")
    else:
        scored = scored.withColumn("feedback_boost", F.lit(None).cast("double"))
    boost = F.coalesce("feedback_boost", F.lit(1.0))
    return scored.withColumn("feedback_boost", boost).withColumn("score", F.round(F.col("_b") * F.col("feedback_boost"), 2)).drop("_b").orderBy(F.desc("score"), "doc_id").limit(limit)


def topic_search(docs: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(doc_id, score): 100 for documents whose topic holds the query, else 50 times the share of its words there."""
    low = query.lower()
    words = list(dict.fromkeys(low.split()))
    topic = F.lower("topic")
    share = sum((topic.contains(w).cast("int") for w in words), F.lit(0)) / max(1, len(words)) * 50
    scored = docs.where(F.col("topic").isNotNull() & (F.col("topic") != "")).select("doc_id", F.when(topic.contains(low), 100.0).otherwise(F.round(share, 6)).alias("score"))
    return scored.where("score > 0").orderBy(F.desc("score"), "doc_id").limit(limit)


def feedback_boosts(events: DataFrame, as_of: str) -> DataFrame:
    """(doc_id, likes, dislikes, last_ts, boost, status) of (doc_id, ts, feedback 'like' or 'dislike'): 0.5 + 1.5 * share of likes, and up to 0.2 more in the week after the last vote, at most 2."""
    votes = events.where(F.col("feedback").isin("like", "dislike")).groupBy("doc_id").agg(F.sum((F.col("feedback") == "like").cast("int")).alias("likes"), F.sum((F.col("feedback") == "dislike").cast("int")).alias("dislikes"), F.max("ts").alias("last_ts"), F.max_by("feedback", F.struct("ts", "feedback")).alias("last"))
    days = F.floor((F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("last_ts")) / 86400)
    base = 0.5 + F.col("likes") / (F.col("likes") + F.col("dislikes")) * 1.5
    boost = F.when(days <= 7, F.least(F.lit(2.0), base + 0.2 * (1 - days / 7))).otherwise(base)
    return votes.select("doc_id", "likes", "dislikes", "last_ts", F.round(boost, 6).alias("boost"), F.when(F.col("last") == "like", "liked").otherwise("disliked").alias("status"))

