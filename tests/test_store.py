"""Search, feedback, stores, chunks and dashboards on literal cases."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.operators import analytics as A
from lexloom.operators import chunking as H
from lexloom.operators import search as S
from lexloom.operators import store as ST
from lexloom.plans import store_queries as SQ


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame([(1, "Server guide", "procedure", "Server guide step", "the server text"), (2, "Other", "issue", None, "error in server"), (3, None, None, None, None)], "doc_id int, title string, genre string, topic string, text string")
    tags = spark.createDataFrame([(1, "Server", 1.0, True, 1), (1, "guide", 0.5, False, 2), (2, "server", 0.4, False, 1), (2, "queue", 1.0, False, 2)], "doc_id int, tag string, score double, from_topic boolean, rank int")
    return docs, tags


def test_indexes(index):
    docs, tags = index
    assert {(r.tag, r.doc_id): (r.tag_score, r.from_topic) for r in S.tag_index(tags).collect()}["server", 1] == (1.0, True)
    assert {r.doc_id: r.tags for r in S.document_index(docs, tags).collect()} == {1: ["Server", "guide"], 2: ["server", "queue"], 3: []}


def test_update_equals_rebuild(index, spark):
    _, tags = index
    before = S.tag_index(tags)
    fresh = spark.createDataFrame([("new", 2, 0.3, False)], "tag string, doc_id int, tag_score double, from_topic boolean")
    gone = spark.createDataFrame([(1,)], "doc_id int")
    assert [(r.tag, r.doc_id) for r in S.update_index(before, fresh, gone).collect()] == [("new", 2)]


def test_stage1(index):
    docs, tags = index
    got = [(r.doc_id, r.score) for r in S.stage1(S.tag_index(tags), "server").collect()]
    assert got == [(1, 3.0), (2, 0.8)]
    assert [r.doc_id for r in S.stage1(S.tag_index(tags), "server", docs, "issue").collect()] == [2]
    assert S.stage1(S.tag_index(tags), "zzz").count() == 0


def test_stage2(index, spark):
    docs, tags = index
    boosts = spark.createDataFrame([(2, 2.0)], "doc_id int, boost double")
    got = {r.doc_id: r for r in S.stage2(S.document_index(docs, tags), "server step", boosts).collect()}
    w = 1.3
    assert got[1].base_score == round((50 + 15 + 10 + 1) * w, 2) and got[1].reasons == "topic part,title part,tags"
    assert got[2].base_score == 11.0 and got[2].score == 22.0 and 3 not in got
    assert [(r.doc_id, r.score) for r in S.topic_search(S.document_index(docs, tags), "server guide").collect()] == [(1, 100.0)]


@pytest.mark.parametrize("rows,boost", [([("like", 0)], 2.0), ([("dislike", 30)], 0.5), ([("like", 8), ("dislike", 8)], 1.25), ([("like", 7), ("dislike", 7)], 1.25), ([("like", 0), ("dislike", 0)], 1.45)])
def test_feedback(spark, rows, boost):
    df = spark.createDataFrame([(1, f, d) for f, d in rows] + [(2, "view", 1), (3, None, 1)], "doc_id int, feedback string, days int").withColumn("ts", F.expr("timestamp'2024-02-01 00:00:00' - make_interval(0, 0, 0, days)"))
    got = S.feedback_boosts(df, "2024-02-01 00:00:00").collect()
    assert [(r.doc_id, r.boost) for r in got] == [(1, boost)]


def test_entities_and_timelines(spark):
    log = spark.createDataFrame([("e", "A", "t", ["x"], 1, 1, ("f1", "l1")), ("e", "B", "t", ["x", "y"], 1, 2, ("f1", "l2")), ("e", "B", "t", ["x", "y"], 1, 2, ("f1", "l2")), (None, "Z", None, None, None, None, None)], "entity_id string, name string, entity_type string, aliases array<string>, created_at int, updated_at int, provenance struct<first_seen_artifact_id:string,last_seen_artifact_id:string>")
    got = ST.entity_latest(log).collect()
    assert len(got) == 1 and (got[0].name, got[0].first_seen, got[0].last_seen, got[0].n_rows) == ("B", "f1", "l2", 3)
    events = spark.createDataFrame([("e", i, i, "issue" if i == 3 else "view") for i in range(10)] + [("f", 20, 1, "issue"), ("f", 21, 2, "resolution"), ("g", 30, 1, "view")], "entity string, event_id int, at int, kind string")
    t = {r.entity: r for r in ST.timelines(events, "entity", "event_id", "at", "kind", 4).collect()}
    assert t["e"].status == "active" and t["e"].n_events == 10 and [x.id for x in t["e"].timeline] == [6, 7, 8, 9]
    assert t["f"].status == t["g"].status == "unknown"
    arts = spark.createDataFrame([("l1", "d1"), ("l2", "d2")], "artifact_id string, doc_id string")
    assert {(r.artifact_id, r.doc_id, r.n_entities) for r in ST.linked_artifacts(log.where("entity_id IS NOT NULL"), arts).collect()} == {("f1", None, 1), ("l1", "d1", 1), ("l2", "d2", 1)}


def test_incremental_and_queue(spark):
    a = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    b = spark.createDataFrame([(2,), (3,), (None,)], "k int")
    assert {r.k for r in ST.new_rows(a, b, "k").collect()} == {1, None} and {r.k for r in ST.gone_rows(b, a, "k").collect()} == {3, None}
    assert [r.k for r in ST.pending(a.where("k > 0"), b, "k", 5).collect()] == [1]
    res = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, False)], "k int, at int, ok boolean")
    q = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    assert {r.k: r.status for r in ST.with_status(q, res, "k").collect()} == {1: "DONE", 2: "FAILED", 3: "PENDING"}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. \n1)#가", max_size=600), st.sampled_from([None, "procedure", "report", "issue"]))
def test_packing_loses_nothing(text, genre):
    chunks = H.pack(text, 60, 20, 10, genre)
    covered = {i for a, b, _ in chunks for i in range(a, b)}
    assert all(text[i].isspace() for i in range(len(text)) if i not in covered)
    assert all(a2 >= b1 for (_, b1, _), (a2, _, _) in zip(chunks, chunks[1:]))


def test_packing():
    paras = "\n\n".join(c * 400 for c in "abc")
    assert [(a, b) for a, b, _ in H.pack(paras, 512, 128, 0)] == [(0, 400), (402, 802), (804, 1204)]
    assert H.pack(paras, 512, 128, 5)[1][2].startswith("aaaaa\n\nb")
    assert len(H.pack("one two\n\nkafka here\n\nrest", 512, 3, 0, None, frozenset(["kafka"]))) == 2
    assert H.pack("", 10, 5, 0) == [] and H.pack(" \n ", 10, 5, 0) == []
    steps = "Intro text\n1. first step\n2. second step"
    assert [c for _, _, c in H.pack(steps, 20, 5, 0, "procedure")] == ["Intro text", "1. first step", "2. second step"]


def test_markdown_chunks():
    text = "\n\n".join(["x" * 900, "y" * 900, "z" * 20])
    got = H.markdown_chunks(text)
    assert len(got) == 2 and got[1].endswith("z" * 20) and H.markdown_chunks("") == []


def test_chunk_table(spark):
    df = spark.createDataFrame([(1, "word " * 600, None, ["x"]), (2, None, "issue", None), (3, "  ", None, None), (4, "short", "weird", None)], "doc_id int, text string, genre string, topic array<string>")
    got = H.chunk_documents(df).collect()
    assert {r.doc_id for r in got} == {1, 4} and {r.section_path for r in got} == {"unknown", "weird"}
    rep = spark.createDataFrame([(1, "a", "xx", True), (1, "b", None, False)], "doc_id int, chunk_id string, text string, quoted boolean")
    r = H.chunk_report(rep).first()
    assert (r.n_chunks, r.mean_chars, r.n_quoted, r.mapping_rate) == (2, 2.0, 1, 0.5)


def test_analytics(spark):
    df = spark.createDataFrame([(1, "a" * 60, 3.0), (2, " ", None), (3, None, 7.5)], "doc_id int, title string, v double")
    assert [(r.topic, r.n) for r in A.topic_groups(df).collect()] == [("a" * 50, 1)]
    assert {r.bucket: r.n for r in A.histogram(df, "v", 5).collect()} == {0: 1, 5: 1}
    assert [r[0] for r in spark.createDataFrame([(0.8,), (0.5,), (0.1,)], "c double").select(A.confidence_bucket(F.col("c"))).collect()] == ["high", "mid", "low"]
    one = spark.createDataFrame([("d", 3, "T", None, None)], "doc_id string, chunk_index int, title string, genre string, text string")
    assert A.rag_rows(one).first().chunk_key == "d__c0003" and A.rag_rows(one).first().body == "[title: T | genre: -]\n"
    md = one.select(A.markdown({"A": F.col("title"), "B": F.col("text")}), A.front_matter({"t": F.col("title"), "g": F.col("genre")}, F.col("text")), A.cut(F.repeat(F.col("title"), 300))).first()
    assert md[0] == "## A\nT\n## B\n-" and md[1] == "---\nt: T\ng: \n---\n\n" and len(md[2]) == 204


def test_front_matter_keeps_the_whole_text(spark, tmp_path):
    text = "word " * 5000 + "end"
    spark.createDataFrame([(1, "T", "g", len(text), text), (2, None, None, None, None)], "doc_id int, title string, genre string, n_chars int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.markdown for r in SQ.front_matter(spark, str(tmp_path)).collect()}
    assert got == {1: f"---\ntitle: T\ngenre: g\nchars: {len(text)}\n---\n\n{text}", 2: "---\ntitle: \ngenre: \nchars: \n---\n\n"}


def test_report_keeps_the_whole_answer(spark, tmp_path):
    answer = "answer " * 100 + "end"
    spark.createDataFrame([(1, 1, "old?", "old", None), (1, 2, "why?", answer, "so"), (2, 1, None, None, None)], "entry_id int, logged_at int, question string, portal_answer_snippet string, analysis_summary string").write.parquet(f"{tmp_path}/qna_log.parquet")
    got = {r.entry_id: r.report for r in SQ.report_markdown(spark, str(tmp_path)).collect()}
    assert got == {1: f"## Question\nwhy?\n## Answer\n{answer}\n## Analysis\nso", 2: "## Question\n-\n## Answer\n-\n## Analysis\n-"}


def test_search_many_is_each_search(index, spark):
    docs, tags = index
    full = S.document_index(docs, tags)
    queries = spark.createDataFrame([("a", "server"), ("b", "Server Guide"), ("c", "queue x"), ("d", "nothing"), ("e", " "), ("f", None), ("g", "e")], "qid string, query string")
    staged = S.stage1_many(S.tag_index(tags), queries).collect()
    found = S.search_many(full, S.tag_index(tags), queries).collect()
    for r in queries.where("length(trim(query)) > 0").collect():
        one = S.stage1(S.tag_index(tags), r["query"])
        assert [(x.doc_id, x.score) for x in one.collect()] == [(x.doc_id, x.score) for x in sorted((x for x in staged if x.qid == r.qid), key=lambda x: x["rank"])], r
        want = S.stage2(full.join(one.select("doc_id"), "doc_id", "left_semi"), r["query"]).collect()
        assert [(x.doc_id, x.score, x.reasons) for x in want] == [(x.doc_id, x.score, x.reasons) for x in sorted((x for x in found if x.qid == r.qid), key=lambda x: x["rank"])], r
    assert {x.qid for x in staged} == {"a", "b", "c", "g"}
    assert S.search_many(full, S.tag_index(tags), queries.limit(0)).count() == 0 and S.search_many(full.limit(0), S.tag_index(tags.limit(0)), queries).count() == 0


def test_category_log(spark):
    log = spark.createDataFrame([(1, 1, "a", "manual"), (1, 2, "b", "manual"), (1, 3, "c", "auto"), (2, 1, "a", "manual"), (2, 2, None, "manual"), (3, 1, "x", "auto"), (3, 1, "y", "auto"), (None, 1, "z", "auto")], "doc_id int, at int, category string, by string")
    assert {r.doc_id: (r.manual, r.auto) for r in ST.category_overlay(log).collect()} == {1: ("b", "c"), 2: (None, None), 3: (None, "y")}
    names = spark.createDataFrame([("기타",), ("old",)], "name string")
    ops = spark.createDataFrame([("new", 1, "add"), ("old", 1, "remove"), ("기타", 1, "remove"), ("back", 1, "remove"), ("back", 2, "add"), (None, 1, "add")], "name string, at int, op string")
    assert {r.name for r in ST.edit_categories(names, ops).collect()} == {"기타", "new", "back"}
    assert ST.category_overlay(log.limit(0)).count() == 0


def test_viewer_filter(spark):
    docs = spark.createDataFrame([(1, "report", "en", "t", ["Server"]), (2, "report", "ko", " ", ["queue"]), (3, None, "en", None, [])], "doc_id int, genre string, lang string, topic string, tags array<string>")
    ids = lambda **f: sorted(r.doc_id for r in A.viewer_filter(docs, **f).collect())
    assert ids() == [1, 2, 3] and ids(genre="report") == [1, 2] and ids(language="en", has_topic=False) == [3] and ids(has_topic=True) == [1] and ids(tag="SERV") == [1] and ids(tag="x") == []


def test_timeline_of_ties_and_nulls(spark):
    events = spark.createDataFrame([(1, 1, 5, "issue"), (1, 2, 5, "resolution"), (1, 3, None, "note"), (2, 4, 1, "resolution"), (2, 5, 2, "issue"), (3, 6, 1, None)], "who int, event_id int, at int, kind string")
    got = {r.who: (r.n_events, r.status, len(r.timeline)) for r in ST.timelines(events, "who", "event_id", "at", "kind", 2).collect()}
    assert got == {1: (3, "unknown", 2), 2: (2, "active", 2), 3: (1, "unknown", 1)}


def test_compat_packing_loses_what_the_described_one_loses():
    text = "\n\n".join(c * 400 for c in "abc")
    whole, lossy = H.pack(text, 512, 128, 0), H.pack(text, 512, 128, 0, compat=True)
    assert [t[0] for *_, t in whole] == ["a", "b", "c"] and [t[0] for *_, t in lossy] == ["c"]


def test_markdown_table(spark):
    text = "\n\n".join(["p" * 900, "q" * 900, "r" * 50])
    df = spark.createDataFrame([(1, text), (2, None), (3, "  "), (4, "one")], "doc_id int, text string")
    got = sorted((r.doc_id, r.chunk_index, len(r.text)) for r in H.chunk_markdown(df).collect())
    assert got == [(1, 0, 900), (1, 1, 952), (4, 0, 3)] and H.chunk_markdown(df.limit(0)).count() == 0
