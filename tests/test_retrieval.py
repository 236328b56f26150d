"""Postings, BM25, fusion and metrics on small cases with known results."""

import math

import pytest
from pyspark.sql import functions as F

from lexloom.functions.text import simple_tokens
from lexloom.operators import evaluation as E
from lexloom.operators import postings as P
from lexloom.operators import retrieval as R

DOCS = [("d1", "apple banana apple"), ("d2", "banana cherry"), ("d3", "dates"), ("d4", None), ("d5", "")]


@pytest.fixture(scope="module")
def base(spark):
    docs = spark.createDataFrame(DOCS, "doc_id string, text string")
    post = P.postings(docs, "doc_id", simple_tokens(F.col("text")))
    return docs, post, P.document_frequency(post)


def test_postings(base):
    docs, post, df = base
    got = {(r.doc_id, r.term): (r.tf, r.first_pos, r.dl) for r in post.collect()}
    assert got == {("d1", "apple"): (2, 0, 3), ("d1", "banana"): (1, 1, 3), ("d2", "banana"): (1, 0, 2), ("d2", "cherry"): (1, 1, 2), ("d3", "dates"): (1, 0, 1)}
    assert {r.term: r.df for r in df.collect()} == {"apple": 1, "banana": 2, "cherry": 1, "dates": 1}
    stats = P.corpus_stats(docs, simple_tokens(F.col("text"))).first()
    assert (stats.n_docs, stats.total_len, stats.avgdl) == (5, 6, 1.2)
    assert P.postings(docs.limit(0), "doc_id", simple_tokens(F.col("text"))).count() == 0


def test_top_terms_break_ties_by_place(base, spark):
    docs = spark.createDataFrame([("x", "bb aa cc aa")], "doc_id string, text string")
    post = P.postings(docs, "doc_id", simple_tokens(F.col("text")))
    got = P.top_terms(post, P.document_frequency(post), F.lit(1), 2).orderBy("rank").collect()
    assert [r.term for r in got] == ["aa", "bb"]


def bm25_of(qtf, tf, dl, df, n, avgdl, idfs):
    idf = math.log(n - df + 0.5) - math.log(df + 0.5)
    idf = 0.25 * sum(idfs) / len(idfs) if idf < 0 else idf
    return qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))


def test_bm25(base, spark):
    docs, post, df = base
    queries = spark.createDataFrame([("q1", "apple apple banana"), ("q2", "zzz"), ("q3", None)], "qid string, text string")
    terms = R.query_terms(queries, "qid", simple_tokens(F.col("text")))
    for n in (3, 5):
        idfs = [math.log(n - d + 0.5) - math.log(d + 0.5) for d in (1, 2, 1, 1)]
        idf = R.okapi_idf(df, F.lit(n))
        got = {(r.qid, r.doc_id): (r.score, r["rank"]) for r in R.bm25(post, idf, F.lit(1.2), terms).collect()}
        want = bm25_of(2, 2, 3, 1, n, 1.2, idfs) + bm25_of(1, 1, 3, 2, n, 1.2, idfs)
        assert abs(got["q1", "d1"][0] - want) < 1e-5 and got["q1", "d1"][1] == 1 and ("q1", "d3") not in got and not [k for k in got if k[0] != "q1"]


def test_overlap(spark):
    kw = spark.createDataFrame([("d1", "a", 2), ("d1", "b", 2), ("d2", "c", 1)], "doc_id string, term string, n_k int")
    q = spark.createDataFrame([("q", "a"), ("q", "c"), ("q", "z")], "qid string, term string")
    got = {r.doc_id: r.score for r in R.overlap(kw, q).collect()}
    assert got == pytest.approx({"d1": 0.7 / 3 + 0.3 / 4, "d2": 0.7 / 3 + 0.3 / 3})


@pytest.fixture(scope="module")
def runs(spark):
    bm = spark.createDataFrame([("q", "a", 4.0, 1), ("q", "b", 2.0, 2), ("q", "c", 1.0, 3), ("p", "a", 3.0, 1)], "qid string, doc_id string, score double, rank int")
    kw = spark.createDataFrame([("q", "b", 0.5), ("q", "z", 0.9)], "qid string, doc_id string, score double")
    return bm, kw


def scores(df, q="q"):
    return {r.doc_id: r.score for r in df.collect() if r.qid == q}


def test_fusion(runs):
    bm, kw = runs
    cand = R.candidates(bm, kw)
    assert scores(R.fuse(cand, 0.0)) == {"a": 1.0, "b": 0.5, "c": 0.25}
    assert scores(R.fuse(cand, 0.5)) == {"a": 0.5, "b": 0.75, "c": 0.125}
    assert scores(R.fuse(cand, 7.0)) == {"a": 0.0, "b": 1.0, "c": 0.0}
    assert scores(R.fuse(cand, 0.1, "zscore"), "p") == {"a": 0.0}
    z = scores(R.fuse(cand, 0.0, "zscore"))
    assert z["a"] > 0 and z["b"] == z["c"] == 0
    rrf = scores(R.fuse(cand, 0.0, "rrf"))
    assert rrf["a"] == round(1 / 61, 9) and rrf["c"] == round(1 / 63, 9)
    with pytest.raises(ValueError):
        R.fuse(cand, 0.1, "other")
    assert scores(R.fuse_all(bm, kw)) == {"a": 0.5, "b": round(0.25 + 0.5 * 0.5 / 0.9, 6), "c": 0.125, "z": 0.5}


def test_rerank(runs):
    bm, kw = runs
    got = [(r.doc_id, r.stage) for r in R.rerank(bm, kw, 2).where("qid = 'q'").orderBy("rank").collect()]
    assert got == [("a", 1), ("b", 1), ("c", 2)]
    assert [r.doc_id for r in R.rerank(bm, kw, 2, compat=True).where("qid = 'q'").orderBy("rank").collect()] == ["c", "a", "b"]


def test_metrics(spark):
    run = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("n", "a", 1)], "qid string, doc_id string, rank int")
    qrels = spark.createDataFrame([("q", "b", 2), ("q", "c", 1), ("q", "x", 1), ("q", "y", 0), ("other", "a", 1)], "qid string, doc_id string, rel int")
    got = E.metrics(run, qrels, (1, 3)).first()
    ideal = 2 + 1 / math.log2(3) + 1 / 2
    assert got.n_queries == 2 and got.ndcg_1 == 0 and got.recall_3 == round(2 / 3 / 2, 6) and got.mrr == 0.25
    assert abs(got.ndcg_3 - (2 / math.log2(3) + 1 / 2) / ideal / 2) < 1e-6


def test_keyword_quality(spark):
    kw = spark.createDataFrame([("d1", ["a1 b1", "b1"]), ("d2", [])], "doc_id string, kw array<string>")
    docs = spark.createDataFrame([("d1", ["a1", "c1"]), ("d2", ["a1"])], "doc_id string, tokens array<string>")
    qs = spark.createDataFrame([("q", ["a1", "z1"]), ("e", [])], "qid string, tokens array<string>")
    qrels = spark.createDataFrame([("q", "d1", 1), ("q", "d2", 1), ("e", "d1", 1)], "qid string, doc_id string, rel int")
    got = E.keyword_quality(kw, docs, qs, qrels).first()
    assert (got.qko, got.coverage, got.diversity, got.avg_keywords) == (0.25, 0.5, round(2 / 3, 6), 2.0)


def test_truncate_and_best(spark):
    docs = spark.createDataFrame([("a",), ("b",), ("c",)], "doc_id string")
    qs = spark.createDataFrame([("q1",), ("q2",), ("q3",)], "qid string")
    qrels = spark.createDataFrame([("q1", "c", 1), ("q2", "a", 1), ("q3", "b", 1)], "qid string, doc_id string, rel int")
    d, q, r = E.truncate(docs, qs, qrels, 2, 1)
    assert [x.doc_id for x in d.collect()] == ["a", "b"] and [x.qid for x in q.collect()] == ["q2"] and r.count() == 1
    s = spark.createDataFrame([("m", "x", 1.0), ("n", "x", 1.0), ("m", "y", 0.1)], "model string, g string, v double")
    assert {(x.g, x.best) for x in E.best_models(s, "g", "v").collect()} == {("x", "m"), ("y", "m")}


def test_prior_frequency_is_a_running_count(spark):
    rows = [(f"d{i:02}", "t" if i % 2 else "u", f"2024-01-0{1 + i // 5} 0{i % 5}:00:00") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id string, term string, at string").withColumn("at", F.col("at").cast("timestamp"))
    got = {r.doc_id: r.prior_df for r in P.prior_frequency(df).collect()}
    assert got == {f"d{i:02}": i // 2 for i in range(20)}


def test_latest_and_states(spark):
    df = spark.createDataFrame([("a", 1, "x", None), ("a", 2, "y", 3), ("a", 2, "y", 3), (None, 9, "z", 1)], "k string, at int, v string, extra int")
    assert [tuple(r) for r in P.latest(df, "k", "at").collect()] == [("a", 2, "y", 3)]
    st = spark.createDataFrame([("s1", "b1", 1, {"t": 1}), ("s2", "b1", 2, {"t": 5}), ("s3", "b1", 3, None), ("s4", "b2", 1, {"t": 1, "u": 2})], "state_id string, batch_id string, updated_at int, df map<string,int>")
    assert {r.term: r.df for r in P.merge_states(st).collect()} == {"t": 6, "u": 2}


def test_metrics_by_model_are_those_of_each_run(spark):
    run = spark.createDataFrame([("m", 1, 10, 1), ("m", 1, 11, 2), ("n", 1, 11, 1), ("n", 2, 12, 1), ("m", 2, 13, 1)], "model string, qid int, doc_id int, rank int")
    qrels = spark.createDataFrame([(1, 11, 2), (1, 14, 1), (3, 11, 1), (2, 12, 0)], "qid int, doc_id int, rel int")
    by = {r.model: r.asDict() for r in E.metrics(run, qrels, (1, 10), ("model",)).collect()}
    for m in ("m", "n"):
        alone = E.metrics(run.where(F.col("model") == m), qrels, (1, 10)).collect()[0].asDict()
        assert {k: v for k, v in by[m].items() if k != "model"} == alone
    assert by["m"]["n_queries"] == 2 and by["n"]["mrr"] == 0.5
    assert E.metrics(run.limit(0), qrels, (1,), ("model",)).count() == 0


def test_keyword_quality_by_model(spark):
    kw = spark.createDataFrame([("a", 1, ["red fish"]), ("b", 1, ["blue"]), ("b", 2, ["fish"])], "model string, doc_id int, kw array<string>")
    docs = spark.createDataFrame([(1, ["red", "fish", "blue"]), (2, ["fish"])], "doc_id int, tokens array<string>")
    queries = spark.createDataFrame([(1, ["fish"])], "qid int, tokens array<string>")
    qrels = spark.createDataFrame([(1, 1, 1), (1, 2, 1)], "qid int, doc_id int, rel int")
    got = {r.model: (r.qko, r.avg_keywords) for r in E.keyword_quality(kw, docs, queries, qrels, ("model",)).collect()}
    assert got == {"a": (0.5, 1.0), "b": (0.5, 1.0)}


def test_padding(spark):
    run = spark.createDataFrame([(1, 5, 0.5, 1), (1, 2, 0.25, 2)], "qid int, doc_id int, score double, rank int")
    queries, docs = spark.createDataFrame([(1,), (2,)], "qid int"), spark.createDataFrame([(i,) for i in (3, 1, 2, 5, 5)], "doc_id int")
    got = [(r.qid, r.doc_id, r.score, r["rank"]) for r in R.pad(run, queries, docs, 3).orderBy("qid", "rank").collect()]
    assert got == [(1, 5, 0.5, 1), (1, 2, 0.25, 2), (1, 1, 0.0, 3), (2, 1, 0.0, 1), (2, 2, 0.0, 2), (2, 3, 0.0, 3)]
