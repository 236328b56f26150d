"""Postings, retrieval, fusion and evaluation over documents (as the corpus) and eval_items (as the queries).

Judgements are derived: a document is relevant to an item by the number of the
item's sentences that stand in it as sentences.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions.text import simple_tokens, tagging_tokens
from lexloom.operators import evaluation as E
from lexloom.operators import postings as P
from lexloom.operators import retrieval as R
from lexloom.plans.text_queries import SIMPLE_SQL, TAGGING_SQL
from lexloom.session import spread, table

TOP = 100
ALPHAS = (0.0, 0.05, 0.1, 0.2, 0.3)


def _tokens():
    return simple_tokens(F.col("text"))


def _post(spark, d):
    """Postings of the documents; kept, as frequencies, statistics, scores and keywords are all read off them."""
    return P.postings(spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id"), "doc_id", _tokens()).persist()


def _questions(spark, d):
    return table(spark, d, "eval_items").select(F.col("item_id").alias("qid"), F.col("item_text").alias("text"))


def _n_docs(spark, d):
    return table(spark, d, "documents").agg(F.count("*")).scalar()


def _avgdl(spark, d):
    return F.coalesce(_post(spark, d).agg(F.sum("tf")).scalar(), F.lit(0)) / _n_docs(spark, d)


def _df(spark, d):
    return P.document_frequency(_post(spark, d)).persist()  # as small as the vocabulary


def _terms(spark, d):
    return R.query_terms(_questions(spark, d), "qid", _tokens())


def _bm25(spark, d, k=1000):
    return R.bm25(_post(spark, d), R.okapi_idf(_df(spark, d), _n_docs(spark, d)), _avgdl(spark, d), _terms(spark, d), k)


def _keywords(spark, d, k=30):
    return P.top_terms(_post(spark, d), _df(spark, d), _n_docs(spark, d), k)


def _overlap(spark, d):
    return R.overlap(_keywords(spark, d).select("doc_id", "term", "n_k"), _terms(spark, d).select("qid", "term"))


def _candidates(spark, d):
    return R.candidates(_bm25(spark, d), _overlap(spark, d))


def _sentences(text):
    """Distinct sentences of 20 or more letters, without spacing, punctuation and case."""
    keys = F.transform(F.split(text, r"[.!?。]\s+|[.!?。]$"), lambda s: F.regexp_replace(F.lower(s), r"[^0-9a-z가-힣]+", ""))
    return F.array_distinct(F.filter(keys, lambda s: F.length(s) >= 20))


def _qrels(spark, d):
    items = table(spark, d, "eval_items").select(F.col("item_id").alias("qid"), F.explode(_sentences(F.col("item_text"))).alias("s"))
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).where(F.col("text").isNotNull()).select("doc_id", F.explode(_sentences(F.col("text"))).alias("s"))
    return docs.join(items, "s").groupBy("qid", "doc_id").agg(F.count("*").cast("int").alias("rel")).persist()  # few, and read for the gains and for the ideal ones


def doc_frequency(spark, d):
    """Document frequency of every retrieval term."""
    return P.document_frequency(_post(spark, d))


def corpus_statistics(spark, d):
    """Number and lengths of the documents."""
    return P.corpus_stats(spread(table(spark, d, "documents").select("text")), _tokens()).withColumn("avgdl", F.round("avgdl", 6))


def tf_topk_keywords(spark, d):
    """The 30 best terms of every document."""
    return _keywords(spark, d).select("doc_id", "term", F.round("score", 6).alias("score"), "rank")


def prior_df(spark, d):
    """For every record and tag token, in how many earlier records the token was when the record came in."""
    records = P.latest(table(spark, d, "corpus").select("doc_id", "ingested_at", "text"), "doc_id", "ingested_at")
    seen = records.select("doc_id", F.col("ingested_at").alias("at"), F.explode(F.array_distinct(tagging_tokens(F.col("text")))).alias("term"))
    return P.prior_frequency(seen)


def state_df(spark, d):
    """Document frequencies from the saved tagging states."""
    return P.merge_states(table(spark, d, "tagging_state"))


def bm25_search(spark, d):
    """The 100 best documents of every query."""
    return _bm25(spark, d, TOP)


def keyword_only_search(spark, d):
    """The 100 best documents of every query by keyword overlap alone."""
    return R.top_k(_overlap(spark, d), TOP)


def fuse_even(spark, d):
    """BM25 and keywords mixed evenly over the documents of either."""
    return R.fuse_all(_bm25(spark, d), _overlap(spark, d), 0.5, TOP)


def fuse_max(spark, d):
    """BM25 with a tenth of keyword overlap, both divided by their best."""
    return R.fuse(_candidates(spark, d), 0.1, "max", TOP)


def fuse_zscore(spark, d):
    """The same over standardised scores."""
    return R.fuse(_candidates(spark, d), 0.1, "zscore", TOP)


def fuse_rrf(spark, d):
    """The same over reciprocal ranks."""
    return R.fuse(_candidates(spark, d), 0.1, "rrf", TOP)


def rerank_two_stage(spark, d):
    """The 20 best by BM25 ordered anew, then the rest."""
    return R.rerank(_bm25(spark, d), _overlap(spark, d), 20, 0.1, TOP)


def qrels_derived(spark, d):
    """Derived judgements."""
    return _qrels(spark, d)


def retrieval_metrics(spark, d):
    """NDCG, recall and reciprocal rank of BM25."""
    return E.metrics(_bm25(spark, d), _qrels(spark, d))


def alpha_sweep(spark, d):
    """Metrics of the max fusion for each weight; the candidates are computed once for all weights."""
    grid = _candidates(spark, d).withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in ALPHAS])))
    scored = grid.select("alpha", "qid", "doc_id", R.max_score(F.col("alpha"), ("alpha",)).alias("score"))
    return E.metrics(R.top_k(scored, 10, by=("alpha",)), _qrels(spark, d), (10,), ("alpha",)).select("alpha", "ndcg_10")


def keyword_quality(spark, d):
    """Quality of the TF-IDF keywords."""
    kw = _keywords(spark, d).groupBy("doc_id").agg(F.collect_list("term").alias("kw"))
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", _tokens().alias("tokens"))
    return E.keyword_quality(kw, docs, _questions(spark, d).select("qid", _tokens().alias("tokens")), _qrels(spark, d))


def _model_scores(spark, d):
    """(model, metric, value) of three runs over the same candidates, which are scored and judged in one pass."""
    cand = _candidates(spark, d)
    z = R.fuse(cand, 0.1, "zscore", 1 << 30).select("qid", "doc_id", F.col("score").alias("z"))
    scored = cand.withColumns({"max": R.max_score(F.lit(0.1))}).join(z, ["qid", "doc_id"])
    runs = scored.select("qid", "doc_id", F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(c).alias("score")) for n, c in (("bm25", "bm"), ("rake_like_max", "max"), ("zscore", "z"))])).alias("r")).select("qid", "doc_id", "r.model", "r.score")
    return _long(E.metrics(R.top_k(runs, TOP, by=("model",)), _qrels(spark, d), (1, 10), ("model",)))


def _long(scores):
    return scores.select("model", F.explode(F.create_map(*[x for m in ("ndcg_1", "ndcg_10", "recall_10", "mrr") for x in (F.lit(m), F.col(m))])).alias("metric", "value"))


def best_model(spark, d):
    """The best run by each metric."""
    return E.best_models(_model_scores(spark, d), "metric", "value")


def metric_pivot(spark, d):
    """Runs by metric."""
    return _model_scores(spark, d).groupBy("model").pivot("metric", ["mrr", "ndcg_1", "ndcg_10", "recall_10"]).agg(F.first("value"))


def truncate_sample(spark, d):
    """Judgements left after keeping the first 500 documents and 50 queries."""
    docs = table(spark, d, "documents").select("doc_id")
    return E.truncate(docs, _questions(spark, d).select("qid"), _qrels(spark, d), 500, 50)[2]


_POST = f"""
WITH toks AS (SELECT doc_id, {SIMPLE_SQL.format('text')} AS t FROM documents),
placed AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term, unnest(range(len(t))) AS p FROM toks WHERE len(t) > 0),
post AS (SELECT doc_id, term, count(*) AS tf, min(p) AS first_pos, any_value(dl) AS dl FROM placed GROUP BY 1, 2),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
stats AS (SELECT count(*) AS n_docs, sum(len(t)) AS total_len, avg(len(t)) AS avgdl FROM toks),
raw AS (SELECT term, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, stats),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qt AS (SELECT item_id AS qid, unnest({SIMPLE_SQL.format('item_text')}) AS term FROM eval_items),
qterm AS (SELECT qid, term, count(*) AS qtf FROM qt GROUP BY 1, 2),
scores AS (SELECT qid, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM post JOIN qterm USING (term) JOIN idf USING (term), stats GROUP BY 1, 2),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score <> 0) WHERE rank <= 1000),
kws AS (SELECT * FROM (SELECT doc_id, term, score, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, first_pos) AS rank
        FROM (SELECT doc_id, post.term, first_pos, tf * (ln((n_docs + 1.0) / (df + 1)) + 1) AS score FROM post JOIN dfs USING (term), stats)) WHERE rank <= 30),
n_k AS (SELECT doc_id, count(*) AS n_k FROM kws GROUP BY 1), n_q AS (SELECT qid, count(*) AS n_q FROM qterm GROUP BY 1),
ov AS (SELECT qid, doc_id, round(0.7::DOUBLE * n / n_q + 0.3::DOUBLE * n / (n_q + n_k - n), 9) AS score FROM (SELECT qid, doc_id, count(*) AS n FROM kws JOIN qterm USING (term) GROUP BY 1, 2) JOIN n_q USING (qid) JOIN n_k USING (doc_id)),
cand AS (SELECT bm.qid, bm.doc_id, bm.score AS bm, bm.rank AS bm_rank, coalesce(ov.score, 0.0) AS kw FROM bm LEFT JOIN ov ON bm.qid = ov.qid AND bm.doc_id = ov.doc_id),
ds AS (SELECT DISTINCT doc_id, regexp_replace(lower(s), '[^0-9a-z가-힣]+', '', 'g') AS s FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?。]\\s+|[.!?。]$')) AS s FROM documents)),
es AS (SELECT DISTINCT qid, regexp_replace(lower(s), '[^0-9a-z가-힣]+', '', 'g') AS s FROM (SELECT item_id AS qid, unnest(regexp_split_to_array(item_text, '[.!?。]\\s+|[.!?。]$')) AS s FROM eval_items)),
qrels AS (SELECT qid, doc_id, count(*)::INT AS rel FROM ds JOIN es USING (s) WHERE length(s) >= 20 GROUP BY 1, 2),
norm AS (SELECT *, CASE WHEN max(bm) OVER q = 0 THEN 1 ELSE max(bm) OVER q END AS mb, CASE WHEN max(kw) OVER q = 0 THEN 1 ELSE max(kw) OVER q END AS mk FROM cand WINDOW q AS (PARTITION BY qid)),
fmax AS (SELECT qid, doc_id, round(0.9 * (bm / mb) + 0.1 * (kw / mk), 6) AS score FROM norm),
zs AS (SELECT qid, avg(bm) AS ab, stddev_pop(bm) AS sb, avg(kw) AS ak, stddev_pop(kw) AS sk FROM cand GROUP BY 1),
z AS (SELECT qid, doc_id, CASE WHEN sb < 1e-12 THEN 0 ELSE greatest(0, (bm - ab) / sb) END AS zb, CASE WHEN sk < 1e-12 THEN 0 ELSE greatest(0, (kw - ak) / sk) END AS zk FROM cand JOIN zs USING (qid)),
fz AS (SELECT qid, doc_id, round(0.9 * zb + 0.1 * zk, 6) AS score FROM z),
ideal AS (SELECT qid, count(*) AS n, sum(CASE WHEN p <= 1 THEN rel / log2(p + 1) END) AS i1, sum(CASE WHEN p <= 3 THEN rel / log2(p + 1) END) AS i3, sum(CASE WHEN p <= 5 THEN rel / log2(p + 1) END) AS i5,
          sum(CASE WHEN p <= 10 THEN rel / log2(p + 1) END) AS i10, sum(CASE WHEN p <= 100 THEN rel / log2(p + 1) END) AS i100 FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc_id) AS p FROM qrels) GROUP BY 1)
"""  # fmt: skip


def _top(source: str, k: int = TOP) -> str:
    return _POST + f"SELECT qid, doc_id, score, rank FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM {source}) WHERE rank <= {k}"


def _metric_sql(source: str, ks: tuple[int, ...]) -> str:
    """Metrics of the ranked run ``source``."""
    g = ", ".join(f"sum(CASE WHEN rank <= {k} THEN rel / log2(rank + 1) END) AS g{k}, sum(CASE WHEN rank <= {k} THEN 1 END) AS h{k}" for k in ks)
    out = ", ".join([f"round(avg(coalesce(g{k} / i{k}, 0)), 6) AS ndcg_{k}, round(avg(coalesce(h{k} / n, 0)), 6) AS recall_{k}" for k in ks])
    return f"SELECT count(*) AS n_queries, {out}, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM (SELECT DISTINCT qid FROM {source}) LEFT JOIN ideal USING (qid) LEFT JOIN (SELECT r.qid, {g}, min(rank) AS first FROM {source} r JOIN qrels USING (qid, doc_id) GROUP BY 1) USING (qid)"


def _models_sql() -> str:
    ranked = lambda s: f"(SELECT * FROM (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM {s}) WHERE rank <= {TOP})"
    runs = {"bm25": ranked("(SELECT qid, doc_id, bm AS score FROM cand)"), "rake_like_max": ranked("fmax"), "zscore": ranked("fz")}
    return ", models AS (" + " UNION ALL ".join(f"SELECT '{n}' AS model, mrr, ndcg_1, ndcg_10, recall_10 FROM ({_metric_sql(s, (1, 10))})" for n, s in runs.items()) + ")"


QUERIES = {f.__name__: f for f in (doc_frequency, corpus_statistics, tf_topk_keywords, prior_df, state_df, bm25_search, keyword_only_search, fuse_even, fuse_max, fuse_zscore, fuse_rrf, rerank_two_stage, qrels_derived, retrieval_metrics, alpha_sweep, keyword_quality, best_model, metric_pivot, truncate_sample)}

ORACLE = {
    "doc_frequency": _POST + "SELECT term, df FROM dfs",
    "corpus_statistics": _POST + "SELECT n_docs, total_len::BIGINT AS total_len, round(avgdl, 6) AS avgdl FROM stats",
    "tf_topk_keywords": _POST + "SELECT doc_id, term, round(score, 6) AS score, rank FROM kws",
    "prior_df": f"""
        WITH records AS (SELECT doc_id, max((ingested_at, text)) AS b FROM (SELECT doc_id, ingested_at, text FROM corpus WHERE doc_id IS NOT NULL) GROUP BY 1),
        seen AS (SELECT DISTINCT doc_id, seen_at, term FROM (SELECT doc_id, b[1] AS seen_at, unnest({TAGGING_SQL.format('b[2]')}) AS term FROM records))
        SELECT doc_id, term, row_number() OVER (PARTITION BY term ORDER BY seen_at, doc_id) - 1 AS prior_df FROM seen""",
    "state_df": """
        WITH best AS (SELECT batch_id, arg_max(df, (updated_at, state_id)) AS m FROM tagging_state WHERE df IS NOT NULL AND batch_id IS NOT NULL GROUP BY 1)
        SELECT e.key AS term, sum(e.value)::BIGINT AS df FROM (SELECT unnest(map_entries(m)) AS e FROM best) GROUP BY 1""",
    "bm25_search": _top("scores WHERE score <> 0"),
    "keyword_only_search": _top("ov"),
    "fuse_even": _POST + f"""
        , b AS (SELECT qid, doc_id, score / CASE WHEN max(score) OVER (PARTITION BY qid) = 0 THEN 1 ELSE max(score) OVER (PARTITION BY qid) END AS b FROM bm),
        o AS (SELECT qid, doc_id, score / CASE WHEN max(score) OVER (PARTITION BY qid) = 0 THEN 1 ELSE max(score) OVER (PARTITION BY qid) END AS o FROM ov),
        m AS (SELECT qid, doc_id, round(0.5 * coalesce(b, 0) + 0.5 * coalesce(o, 0), 6) AS score FROM b FULL JOIN o USING (qid, doc_id))
        SELECT * FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM m WHERE score > 0) WHERE rank <= {TOP}""",
    "fuse_max": _top("fmax"),
    "fuse_zscore": _top("fz"),
    "fuse_rrf": _top("(SELECT qid, doc_id, round(0.9 / (60 + row_number() OVER (PARTITION BY qid ORDER BY bm DESC, doc_id)) + 0.1 / (60 + row_number() OVER (PARTITION BY qid ORDER BY kw DESC, doc_id)), 9) AS score FROM cand)"),
    "rerank_two_stage": _POST + f"""
        , s AS (SELECT *, CASE WHEN bm_rank <= 20 THEN 1 ELSE 2 END AS stage FROM cand),
        m AS (SELECT *, max(CASE WHEN stage = 1 THEN bm END) OVER (PARTITION BY qid) AS b1, max(CASE WHEN stage = 1 THEN kw END) OVER (PARTITION BY qid) AS k1 FROM s),
        f AS (SELECT qid, doc_id, stage, CASE WHEN stage = 1 THEN round(0.9 * bm / CASE WHEN b1 = 0 THEN 1 ELSE b1 END + 0.1 * kw / CASE WHEN k1 = 0 THEN 1 ELSE k1 END, 6) ELSE bm END AS score FROM m)
        SELECT * FROM (SELECT qid, doc_id, stage, score, row_number() OVER (PARTITION BY qid ORDER BY stage, score DESC, doc_id) AS rank FROM f) WHERE rank <= {TOP}""",
    "qrels_derived": _POST + "SELECT qid, doc_id, rel FROM qrels",
    "retrieval_metrics": _POST + _metric_sql("bm", E.KS),
    "alpha_sweep": _POST + """
        , grid AS (SELECT alpha, qid, doc_id, round((1 - alpha) * bm / mb + alpha * kw / mk, 6) AS score FROM norm, (SELECT unnest([0.0, 0.05, 0.1, 0.2, 0.3])::DOUBLE AS alpha)),
        ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY alpha, qid ORDER BY score DESC, doc_id) AS rank FROM grid) WHERE rank <= 10)
        SELECT alpha, round(avg(coalesce(g / i10, 0)), 6) AS ndcg_10 FROM (SELECT DISTINCT alpha, qid FROM ranked) LEFT JOIN ideal USING (qid)
        LEFT JOIN (SELECT alpha, qid, sum(rel / log2(rank + 1)) AS g FROM ranked JOIN qrels USING (qid, doc_id) GROUP BY 1, 2) USING (alpha, qid) GROUP BY 1""",
    "keyword_quality": _POST + """
        , k AS (SELECT doc_id, list(term) AS kw FROM kws GROUP BY 1), dt AS (SELECT doc_id, list_distinct(t) AS t FROM toks),
        shape AS (SELECT round(avg(len(list_intersect(t, kw)) / len(t)), 6) AS coverage, round(avg(least(1.0, len(list_distinct(kw)) / len(kw))), 6) AS diversity, round(avg(len(kw)), 6) AS avg_keywords FROM k JOIN dt USING (doc_id)),
        ql AS (SELECT qid, list(term) AS q FROM qterm GROUP BY 1),
        o AS (SELECT round(avg(coalesce(len(list_intersect(q, kw)) / len(q), 0)), 6) AS qko FROM qrels JOIN ql USING (qid) LEFT JOIN k USING (doc_id))
        SELECT qko, coverage, diversity, avg_keywords FROM shape, o""",
    "best_model": _POST + _models_sql() + " SELECT metric, arg_min(model, (-value, model)) AS best, max(value) AS value FROM (UNPIVOT models ON mrr, ndcg_1, ndcg_10, recall_10 INTO NAME metric VALUE value) GROUP BY 1",
    "metric_pivot": _POST + _models_sql() + " SELECT model, mrr, ndcg_1, ndcg_10, recall_10 FROM models",
    "truncate_sample": _POST + """
        , kept AS (SELECT * FROM qrels WHERE doc_id IN (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 500)),
        first AS (SELECT qid FROM kept GROUP BY 1 ORDER BY qid LIMIT 50)
        SELECT qid, doc_id, rel FROM kept WHERE qid IN (SELECT qid FROM first)""",
}
