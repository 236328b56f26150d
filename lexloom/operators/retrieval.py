"""BM25, keyword overlap, score fusion and reranking; runs are DataFrames of (qid, doc_id, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DECIMALS = 6  # scores are rounded before ranking, so that ranks don't hang on the order of summation


def query_terms(queries: DataFrame, qid: str, tokens: Column) -> DataFrame:
    """(qid, term, qtf) of the queries; a query without tokens has no row."""
    return queries.select(F.col(qid).alias("qid"), F.explode(tokens).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def okapi_idf(df: DataFrame, n_docs: Column, epsilon: float = 0.25) -> DataFrame:
    """(term, idf): ln(N - df + 0.5) - ln(df + 0.5); a negative one becomes ``epsilon`` times the mean over all terms."""
    raw = df.withColumn("raw", F.log(n_docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw")).scalar()
    return raw.select("term", F.when(F.col("raw") < 0, epsilon * mean).otherwise(F.col("raw")).alias("idf"))


def top_k(run: DataFrame, k: int, score: str = "score", by: tuple[str, ...] = ()) -> DataFrame:
    """The k best documents of each query (in each group ``by``) with their rank; ties by doc_id."""
    rank = F.row_number().over(W.partitionBy(*by, "qid").orderBy(F.desc(score), "doc_id"))
    return run.withColumn("rank", rank).where(F.col("rank") <= k)


def bm25(post: DataFrame, idf: DataFrame, avgdl: Column, terms: DataFrame, k: int = 1000, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(qid, doc_id, score, rank): Okapi BM25 of every query over all documents that share a term with it.

    The join is on the term.  Query terms are few, so they are joined to their
    weights first, and the postings are reduced to those terms; scores are
    summed up before anything is ranked.  Documents that score 0 are left out.
    """
    wanted = terms.join(idf, "term")
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    scores = post.join(wanted, "term").groupBy("qid", "doc_id").agg(F.round(F.sum(part), DECIMALS).alias("score"))
    return top_k(scores.where(F.col("score") != 0), k)


def overlap(keyword_terms: DataFrame, terms: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, qid, doc_id, score): 0.7 |Q and K| / |Q| + 0.3 |Q and K| / |Q or K| over the token sets of query and document keywords.

    ``keyword_terms``: (doc_id, term, n_k) with the document's number of
    keyword tokens, and the columns ``by``, such as the model; ``terms``:
    distinct (qid, term).  An inverted join, so only
    pairs that share a token appear; the rest are 0.
    """
    query_size = terms.groupBy("qid").agg(F.count("*").alias("n_q"))
    both = keyword_terms.join(terms, "term").groupBy(*by, "qid", "doc_id").agg(F.count("*").alias("n"), F.max("n_k").alias("n_k"))
    score = 0.7 * F.col("n") / F.col("n_q") + 0.3 * F.col("n") / (F.col("n_q") + F.col("n_k") - F.col("n"))
    return both.join(query_size, "qid").select(*by, "qid", "doc_id", F.round(score, 9).alias("score"))


def _best(score: str, by: tuple[str, ...] = ()) -> Column:
    top = F.max(score).over(W.partitionBy(*by, "qid"))
    return F.when(top == 0, 1.0).otherwise(top)


def fuse_all(bm: DataFrame, kw: DataFrame, weight: float = 0.5, k: int = 1000) -> DataFrame:
    """Both runs divided by their best score and mixed over all documents of either."""
    b = bm.select("qid", "doc_id", (F.col("score") / _best("score")).alias("b"))
    o = kw.select("qid", "doc_id", (F.col("score") / _best("score")).alias("o"))
    mixed = b.join(o, ["qid", "doc_id"], "full_outer")
    score = F.round((1 - weight) * F.coalesce("b", F.lit(0.0)) + weight * F.coalesce("o", F.lit(0.0)), DECIMALS)
    return top_k(mixed.select("qid", "doc_id", score.alias("score")).where(F.col("score") > 0), k)


def candidates(bm: DataFrame, kw: DataFrame, most: int = 1000) -> DataFrame:
    """(qid, doc_id, bm, kw): the BM25 candidates with their keyword score (0 where none)."""
    return bm.where(F.col("rank") <= most).select("qid", "doc_id", F.col("score").alias("bm"), F.col("rank").alias("bm_rank")).join(kw.select("qid", "doc_id", F.col("score").alias("kw")), ["qid", "doc_id"], "left").withColumn("kw", F.coalesce("kw", F.lit(0.0)))


def max_score(alpha: Column, by: tuple[str, ...] = ()) -> Column:
    """(1 - alpha) BM25 + alpha keywords, each divided by its best of the query (in each group ``by``)."""
    return F.round((1 - alpha) * (F.col("bm") / _best("bm", by)) + alpha * (F.col("kw") / _best("kw", by)), DECIMALS)


def fuse(cand: DataFrame, alpha: float = 0.1, mode: str = "max", k: int = 1000) -> DataFrame:
    """(qid, doc_id, score, rank): (1 - alpha) BM25 + alpha keywords over the candidates; mode max, zscore or rrf."""
    alpha = min(1.0, max(0.0, alpha))
    q = W.partitionBy("qid")
    if mode == "max":
        parts = (F.col("bm") / _best("bm"), F.col("kw") / _best("kw"))
    elif mode == "zscore":

        def z(c: str) -> Column:
            std = F.stddev_pop(c).over(q)
            return F.when(std < 1e-12, 0.0).otherwise(F.greatest(F.lit(0.0), (F.col(c) - F.avg(c).over(q)) / std))

        parts = (z("bm"), z("kw"))
    elif mode == "rrf":
        rank = lambda c: F.row_number().over(q.orderBy(F.desc(c), "doc_id"))
        parts = (1.0 / (60 + rank("bm")), 1.0 / (60 + rank("kw")))
    else:
        raise ValueError(f"unknown fusion mode {mode!r}")
    digits = DECIMALS if mode != "rrf" else 9
    fused = cand.select("qid", "doc_id", parts[0].alias("_b"), parts[1].alias("_k"))
    return top_k(fused.select("qid", "doc_id", F.round((1 - alpha) * F.col("_b") + alpha * F.col("_k"), digits).alias("score")), k)


def rerank(bm: DataFrame, kw: DataFrame, top: int = 100, weight: float = 0.1, k: int = 1000, compat: bool = False) -> DataFrame:
    """The ``top`` BM25 documents ordered by mixed score, then the rest in BM25 order.

    ``compat`` orders by the raw numbers instead, so that documents of the
    rest with scores over 1 come first.
    """
    c = candidates(bm, kw, 1 << 30).withColumn("stage", F.when(F.col("bm_rank") <= top, 1).otherwise(2))
    best_bm = F.max(F.when(F.col("stage") == 1, F.col("bm"))).over(W.partitionBy("qid"))
    best_kw = F.max(F.when(F.col("stage") == 1, F.col("kw"))).over(W.partitionBy("qid"))
    one = lambda x: F.when(x == 0, 1.0).otherwise(x)
    score = F.when(F.col("stage") == 1, F.round((1 - weight) * F.col("bm") / one(best_bm) + weight * F.col("kw") / one(best_kw), DECIMALS)).otherwise(F.col("bm"))
    order = [] if compat else ["stage"]
    scored = c.select("qid", "doc_id", "stage", score.alias("score"))
    rank = F.row_number().over(W.partitionBy("qid").orderBy(*order, F.desc("score"), "doc_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def pad(run: DataFrame, queries: DataFrame, docs: DataFrame, k: int = 1000) -> DataFrame:
    """The run (qid, doc_id, score, rank) filled up to ``k`` documents a query with documents that score 0, in the order of their ids.

    The first ``k`` ids suffice for every query, so they go along as one list
    of at most ``k`` entries.
    """
    first = docs.select("doc_id").distinct().orderBy("doc_id").limit(k).agg(F.array_sort(F.collect_list("doc_id"))).scalar()
    rest = queries.select("qid", F.explode(first).alias("doc_id")).join(run.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti").withColumn("score", F.lit(0.0))
    every = run.select("qid", "doc_id", "score", "rank").unionByName(rest.withColumn("rank", F.lit(None).cast("int")))
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.col("rank").asc_nulls_last(), "doc_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k)
