"""Postings, term statistics and the document frequency state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str | list[str], order: str) -> DataFrame:
    """One row per key: the latest by ``order``, ties by the greatest of the other values; rows with a null key drop out.

    An aggregation (with partial combination), not a window, so a key that
    holds many rows costs no sort.
    """
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in df.columns if c not in keys and c != order]
    best = F.max(F.struct(order, *rest)).alias("_b")
    out = df
    for k in keys:
        out = out.where(F.col(k).isNotNull())
    return out.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in [order, *rest]])


def postings(docs: DataFrame, doc_id: str, tokens: Column) -> DataFrame:
    """(doc_id, term, tf, first_pos, dl, n_terms): occurrences of each distinct term of a document, its first position, the document's length and its number of distinct terms.

    Documents without tokens have no row; ids must be distinct.  Where the
    documents are partitioned by id the counting needs no exchange.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), tokens.alias("t")).withColumns({"dl": F.size("t"), "n_terms": F.size(F.array_distinct("t"))})
    placed = base.select("doc_id", "dl", "n_terms", F.posexplode("t").alias("p", "term"))  # sizes come first: they are per document, not per token
    counted = placed.groupBy("doc_id", "dl", "n_terms", "term").agg(F.count("*").alias("tf"), F.min("p").alias("first_pos"))
    return counted.select("doc_id", "term", "tf", "first_pos", "dl", "n_terms")


def document_frequency(post: DataFrame) -> DataFrame:
    """(term, df) of postings."""
    return post.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(docs: DataFrame, tokens: Column) -> DataFrame:
    """One row: n_docs (documents without tokens included), total_len, avgdl."""
    return docs.select(F.size(tokens).alias("n")).agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_len"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("avgdl"))


def top_terms(post: DataFrame, df: DataFrame, n_docs: Column, k: int = 30) -> DataFrame:
    """(doc_id, term, score, rank, n_k): the k best terms of each document by tf * (ln((N + 1) / (df + 1)) + 1), and how many the document has; ties by first occurrence."""
    scored = post.join(df, "term").withColumn("score", F.col("tf") * (F.log((n_docs + 1) / (F.col("df") + 1)) + 1))
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc(F.round("score", 9)), "first_pos"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("doc_id", "term", "score", "rank", F.least("n_terms", F.lit(k)).alias("n_k"))


def prior_frequency(first_seen: DataFrame, slices: str = "hour") -> DataFrame:
    """(doc_id, term, prior_df): how many earlier documents had the term when each document came in.

    ``first_seen``: (doc_id, term, at), one row per document and term; the
    order is by ``at`` and ``doc_id``.  A frequent term is not one long
    window: its rows are numbered within time slices and the slices' totals
    are summed up beside.
    """
    cut = first_seen.withColumn("_s", F.date_trunc(slices, "at"))
    per = cut.groupBy("term", "_s").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("term").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = per.select("term", "_s", before.alias("_before"))
    within = F.row_number().over(W.partitionBy("term", "_s").orderBy("at", "doc_id")) - 1
    return cut.withColumn("_in", within).join(totals, ["term", "_s"]).select("doc_id", "term", (F.col("_before") + F.col("_in")).alias("prior_df"))


def merge_states(states: DataFrame) -> DataFrame:
    """(term, df) over saved states: the latest state with content of each batch counts, and batches add up."""
    good = states.where(F.col("df").isNotNull() & F.col("batch_id").isNotNull()).select("batch_id", "updated_at", "state_id", F.map_entries("df").alias("e"))
    best = good.groupBy("batch_id").agg(F.max(F.struct("updated_at", "state_id", "e")).alias("b"))
    return best.select(F.explode("b.e").alias("x")).groupBy(F.col("x.key").alias("term")).agg(F.sum("x.value").alias("df"))
