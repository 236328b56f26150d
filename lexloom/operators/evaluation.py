"""Retrieval and keyword quality metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KS = (1, 3, 5, 10, 100)


def truncate(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, max_docs: int, max_queries: int, doc_order: str = "doc_id", query_order: str = "qid") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The first documents in order, the judgements of those documents, and the first queries that still have one."""
    docs = corpus.orderBy(doc_order).limit(max_docs)
    kept = qrels.join(docs.select("doc_id"), "doc_id", "left_semi")
    first = queries.join(kept.select("qid"), "qid", "left_semi").orderBy(query_order).limit(max_queries)
    return docs, first, kept.join(first.select("qid"), "qid", "left_semi")


def metrics(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = KS, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each group ``by``): ndcg_k (linear gain), recall_k and mrr, averaged over the queries of the run.

    ``run`` has (qid, doc_id, rank) and the columns ``by``, such as the model,
    ``qrels`` (qid, doc_id, rel).  Documents without a judgement count 0; a
    query of the run without a relevant document counts 0 everywhere.  The run
    is read once; the judgements, which are few, twice.
    """
    judged = qrels.where(F.col("rel") > 0)
    hit = F.col("rel").isNotNull()
    gain = lambda rank, k: F.sum(F.when(F.col(rank) <= k, F.col("rel") / F.log2(F.col(rank) + 1)))
    found = [F.sum(F.when(hit & (F.col("rank") <= k), 1)).alias(f"h{k}") for k in ks]
    per_query = run.join(judged, ["qid", "doc_id"], "left").groupBy(*by, "qid").agg(*[gain("rank", k).alias(f"g{k}") for k in ks], *found, F.min(F.when(hit, F.col("rank"))).alias("first"))
    place = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("rel"), "doc_id"))
    ideal = judged.withColumn("p", place).groupBy("qid").agg(F.count("*").alias("n"), *[gain("p", k).alias(f"i{k}") for k in ks])
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return (
        per_query.join(ideal, "qid", "left")
        .groupBy(*by)
        .agg(
            F.count("*").alias("n_queries"),
            *[F.round(F.avg(zero(F.col(f"g{k}") / F.col(f"i{k}"))), 6).alias(f"ndcg_{k}") for k in ks],
            *[F.round(F.avg(zero(F.col(f"h{k}") / F.col("n"))), 6).alias(f"recall_{k}") for k in ks],
            F.round(F.avg(zero(1.0 / F.col("first"))), 6).alias("mrr"),
        )
    )


def keyword_quality(keywords: DataFrame, doc_tokens: DataFrame, query_tokens: DataFrame, qrels: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each group ``by`` of the keywords, such as the model): qko, coverage, diversity, avg_keywords.

    ``keywords``: (doc_id, kw array<string>) with the keywords as token lists
    joined by blanks; ``doc_tokens``: (doc_id, tokens), ``query_tokens``:
    (qid, tokens).  QKO is the share of the query's tokens among the keyword
    tokens, over pairs judged relevant (documents without keywords count 0,
    queries without tokens are skipped); coverage the share of the document's
    distinct tokens among them; diversity the distinct tokens over the sum of
    each keyword's distinct tokens, at most 1.
    """
    words = lambda k: F.array_distinct(F.filter(F.split(k, r"[^a-z0-9]+"), lambda w: F.length(w) >= 2))
    kw = keywords.where(F.size("kw") > 0).select(*by, "doc_id", F.size("kw").alias("n"), F.array_distinct(F.flatten(F.transform("kw", words))).alias("kt"), F.aggregate(F.transform("kw", lambda k: F.size(words(k))), F.lit(0), lambda a, x: a + x).alias("total"))
    with_doc = kw.join(doc_tokens.select("doc_id", F.array_distinct("tokens").alias("dt")), "doc_id")
    shape = with_doc.groupBy(*by).agg(
        F.round(F.avg(F.when(F.size("dt") > 0, F.size(F.array_intersect("dt", "kt")) / F.size("dt"))), 6).alias("coverage"),
        F.round(F.avg(F.when(F.col("total") > 0, F.least(F.lit(1.0), F.size("kt") / F.col("total")))), 6).alias("diversity"),
        F.round(F.avg("n"), 6).alias("avg_keywords"),
    )
    q = query_tokens.select("qid", F.array_distinct("tokens").alias("qt")).where(F.size("qt") > 0)
    pairs = qrels.where(F.col("rel") > 0).join(q, "qid")
    if not by:
        pairs = pairs.join(kw.select("doc_id", "kt"), "doc_id", "left")
    else:  # a pair counts in every group, with 0 where the group has no keywords of the document
        groups = F.array_sort(F.collect_set(F.struct(*by)))
        every = pairs.withColumn("_g", F.explode(kw.agg(groups).scalar())).select("*", *[F.col(f"_g.{c}").alias(c) for c in by])
        pairs = every.join(kw.select(*by, "doc_id", "kt"), [*by, "doc_id"], "left")
    qko = pairs.groupBy(*by).agg(F.round(F.avg(F.coalesce(F.size(F.array_intersect("qt", "kt")) / F.size("qt"), F.lit(0.0))), 6).alias("qko"))
    if not by:
        return shape.select(qko.scalar().alias("qko"), "coverage", "diversity", "avg_keywords")
    return shape.join(qko, list(by), "left").select(*by, "qko", "coverage", "diversity", "avg_keywords")


def best_models(scores: DataFrame, by: str, metric: str, name: str = "model") -> DataFrame:
    """The model with the highest metric in each group; ties by name."""
    return scores.groupBy(by).agg(F.min_by(F.col(name), F.struct(-F.col(metric), F.col(name))).alias("best"), F.max(metric).alias(metric))
