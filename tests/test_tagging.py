"""Keywords, tags, consensus and classifiers on literal cases."""

import pytest
from pyspark.sql import functions as F

from lexloom.functions.constants import GENRE_RULES, GENRE_RULES_LIGHT
from lexloom.operators import classify as C
from lexloom.operators import keywords as K
from lexloom.operators import tagging as T
from lexloom.plans import tagging_queries as TQ


def test_rake(spark):
    df = spark.createDataFrame([(1, "Deep learning of neural nets. Neural nets, and deep learning models!"), (2, None), (3, ""), (4, "x" * 60_000)], "doc_id int, text string")
    got = K.rake(df).orderBy("doc_id", "rank").collect()
    assert {r.doc_id for r in got} == {1}
    assert got[0].phrase == "deep learning models" and got[0].score == 1.0
    assert {r.phrase for r in got} == {"deep learning", "neural nets", "deep learning models"}


def test_rake_query_takes_long_texts(spark, tmp_path):
    text = "the of and " * 5000 + ". Kafka cluster restarted."
    spark.createDataFrame([(1, text), (2, None), (3, "short phrase")], "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.phrase) for r in TQ.rake_keywords(spark, str(tmp_path)).collect()}
    assert len(text) > 50_000 and got == {(1, "kafka cluster restarted"), (3, "short phrase")}


def test_yake(spark):
    text = "Kafka cluster restarted. The Kafka cluster was restarted by the operator after the broker failed. Broker logs show the reason."
    got = K.yake_terms(text)
    assert got and got[0][1] == 1.0 and "kafka" in " ".join(p for p, _ in got[:4]) and all(0 < s <= 1 for _, s in got)
    assert K.yake_terms("") == [] and K.yake_terms("the of and") == []
    df = spark.createDataFrame([(1, text), (1, text), (2, None), (3, "")], "doc_id int, text string")
    assert {r.doc_id for r in K.yake(df).collect()} == {1}


def test_yake_reads_the_whole_text(spark):
    late = "of the and " * 1000 + ". Kafka cluster restarted."
    df = spark.createDataFrame([(1, late)], "doc_id int, text string")
    got = [(r.phrase, r.score) for r in K.yake(df).orderBy("rank").collect()]
    assert got == [(p, round(s, 6)) for p, s in K.yake_terms(late)] and "kafka cluster restarted" in {p for p, _ in got}


def test_combination(spark):
    a = spark.createDataFrame([(1, ["X y", "b"]), (2, ["q"])], "doc_id int, kw array<string>")
    b = spark.createDataFrame([(1, ["x Y ", "c", "d"])], "doc_id int, kw array<string>")
    assert {r.doc_id: r.kw for r in K.ordered_union([a, b], 3).collect()} == {1: ["x y", "b", "c"], 2: ["q"]}
    p = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "doc_id int, phrase string, rank int")
    q = spark.createDataFrame([(1, "y", 1)], "doc_id int, phrase string, rank int")
    got = [(r.phrase, r.score) for r in K.weighted_vote([(p, 0.7), (q, 0.3)], 2).orderBy("rank").collect()]
    assert got == [("y", round(0.7 * (1 - 1 / 5) + 0.3, 6)), ("x", 0.7)]


def test_mmr():
    assert K.mmr([("a", 1.0), ("b", 0.5)], 5) == ["a", "b"]
    got = K.mmr([("red apple", 1.0), ("red apple pie", 0.95), ("green pear", 0.8), ("apple", 0.5)], 2)
    assert got == ["red apple", "green pear"]


def brute_mmr(c, k, lam):
    words = {x: set(x.split()) for x, _ in c}
    rel = {x: s / max(s for _, s in c) for x, s in c}
    out = []
    while len(out) < k and len(out) < len(c):
        out.append(max((x for x, _ in c if x not in out), key=lambda x: lam * rel[x] - (1 - lam) * max([len(words[x] & words[y]) / len(words[x] | words[y]) for y in out], default=0.0)))
    return out


def test_mmr_against_plain():
    c = [(f"w{i % 5} w{i % 3} w{i}", 1 - i / 40) for i in range(30)]
    assert K.mmr(c, 10) == brute_mmr(c, 10, 0.7)


def test_tags(spark):
    df = spark.createDataFrame([(1, "server log log queue", "queue", "record"), (2, "log index", None, None), (3, None, None, None)], "doc_id int, text string, title string, genre string")
    terms, dfs = T.tagging_terms(df), T.term_df(df)
    got = {(r.doc_id, r.tag): r for r in T.tfidf_tags(terms, dfs, F.lit(3)).collect()}
    assert (1, "server") not in got and got[1, "log"].weight == 1.4 and got[1, "queue"].from_topic and got[1, "log"].score == 1.0
    assert {r["rank"] for k, r in got.items() if k[0] == 2} == {1, 2}
    assert T.bm25_tags(terms, dfs, F.lit(3), F.lit(2.0)).count() == len(got)
    assert T.tfidf_tags(T.tagging_terms(df.limit(0)), T.term_df(df.limit(0)), F.lit(0)).count() == 0


def test_domain_pattern(spark):
    rows = [("ORA-00936", True), ("sqlstate 1", True), ("XEDRM5", True), ("WAS_PATCH", True), ("NullPointerException", True), ("kafka", False), ("Kafka_cluster", False), ("", False)]
    df = spark.createDataFrame([(p, w) for p, w in rows], "phrase string, want boolean")
    assert all(r.want == r.got for r in df.select("want", T.domain_pattern(F.col("phrase")).alias("got")).collect())


def test_consensus(spark):
    merged = spark.createDataFrame([(1, "a", "a", 1, False, 1.0, 1.0, 0.8), (1, "b", "b", 1, False, 0.5, 0.5, None), (1, "c", "c", 1, True, 0.2, 0.2, None), (1, "d", "d", 1, False, 0.9, None, 0.9)], "doc_id int, tag string, norm_key string, n_phrases int, domain boolean, best double, rake double, yake double")
    stats = spark.createDataFrame([(1, "a", 1.0, 1), (1, "d", 0.5, 2)], "doc_id int, tag string, stat double, stat_rank int")
    got = {r.tag: r for r in T.consensus(merged, stats, "rake", "yake").collect()}
    assert got["a"].votes == 3 and got["a"].confidence == round((0.3 + 0.24 + 0.4) * 1.2, 6)
    assert got["d"].votes == 2 and got["d"].confidence == round((0.27 + 0.2) / 0.7, 6) and "b" not in got and "c" not in got
    alone = spark.createDataFrame([(1, "c", 0.4, 1)], "doc_id int, tag string, stat double, stat_rank int")
    one = {r.tag: r for r in T.consensus(merged.where("tag = 'c'"), alone, "rake", "yake").collect()}
    assert one["c"].votes == 2


def test_slices(spark):
    df = spark.createDataFrame([(1, "a" * 25), (2, "b")], "doc_id int, text string")
    got = sorted((r.doc_id, r.slice, len(r.text)) for r in T.sliced(df, 10, 20).collect())
    assert got == [(1, 0, 10), (1, 1, 10), (1, 2, 5), (2, 0, 1)]
    tags = spark.createDataFrame([(1, "A", 0.2), (1, "a", 0.9), (1, "b", 0.5)], "doc_id int, tag string, confidence double")
    assert [(r.tag, r.confidence) for r in T.merge_slices(tags).orderBy("rank").collect()] == [("a", 0.9), ("b", 0.5)]


@pytest.mark.parametrize("text,want", [("An error occurred, timeout", "issue"), ("errors occurred", "unknown"), ("error가", "unknown"), ("장애 발생", "issue"), ("월간 보고 요약", "report"), ("유지보수 점검", "maintenance"), ("plain words", "unknown"), (None, "unknown"), ("NoRouteToHost", "issue")])
def test_genres(spark, text, want):
    df = spark.createDataFrame([(1, None, text)], "doc_id int, title string, text string")
    got = C.classify_genre(df, GENRE_RULES, 120, ["doc_id"]).first()
    assert got.genre == want and (got.confidence == 0.2) == (want == "unknown")


def test_light_genres_and_evidence(spark):
    df = spark.createDataFrame([(1, "계약", "첫 줄\n견적 제안\n다른 줄\n발주")], "doc_id int, title string, text string")
    got = C.classify_genre(df, GENRE_RULES_LIGHT, 80, ["doc_id"]).first()
    assert got.genre == "contract" and got.hits == 4 and got.evidence == "견적 제안\n발주" and got.confidence == 0.83


def test_entities(spark):
    df = spark.createDataFrame([(1, "K사", "Tomcat 9.0.1 and 9.0.1, ORA-00936; FooException ABCDEF-12 1.2.3.4 고객사는"), (2, None, None)], "doc_id int, title string, text string")
    got = {(r.entity_type, r.name) for r in C.extract_entities(df, ["doc_id"]).collect()}
    assert got == {("customer", "K사"), ("product", "Tomcat"), ("version", "9.0.1"), ("version", "1.2.3"), ("issue", "FooException"), ("issue", "ORA-00936")}


def test_answers(spark):
    df = spark.createDataFrame([("정보를 찾을 수 없습니다. 다시 질문해 주시겠어요?", False), ("short", False), (None, False), ("This answer is long enough to be one.", True)], "a string, want boolean")
    assert all(r.want == r.got for r in df.select("want", C.is_meaningful(F.col("a")).alias("got")).collect())
    q = spark.createDataFrame([("- one\n2) two\n\n one\n",), (None,)], "a string")
    assert [r[0] for r in q.select(C.follow_ups(F.col("a"))).collect()] == [["one", "two"], None]


def test_kmeans(spark):
    rows = [(i, [float(i % 2) * 10 + i * 0.01, 0.0], i % 2) for i in range(40)] + [(99, None, 1)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>, label int")
    got = C.kmeans_categories(df, k=2).collect()
    assert len(got) == 40 and all(r.category == r.vec_id % 2 and 0.5 <= r.confidence <= 1 for r in got)


def test_fallback_keywords(spark):
    docs = spark.createDataFrame([(1, "b a b c"), (2, "x"), (3, None)], "doc_id int, text string")
    found = spark.createDataFrame([(2, "x")], "doc_id int, phrase string")
    got = {r.doc_id: r.kw for r in K.fallback_keywords(docs, found, F.split(F.coalesce("text", F.lit("")), " "), 2).collect()}
    assert got == {1: ["b", "a"], 3: [""]} and K.fallback_keywords(docs.limit(0), found, F.split("text", " ")).count() == 0


def test_patterns_as_words(spark):
    df = spark.createDataFrame([("the error here",), ("terrors",), ("ora-12 오류",), ("how to do",), (None,)], "t string")
    has = lambda p: [r[0] for r in df.select(C.has_pattern(F.col("t"), p)).collect()]
    assert has(r"\berror\b") == [True, False, False, False, None] and has("오류") == [False, False, True, False, None]
    assert has(r"ora-\d+") == [False, False, True, False, None] and has(r"\bhow to\b") == [False, False, False, True, None] and has("error|오류") == [True, True, True, False, None]
