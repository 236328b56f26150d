"""Image queue, labels and loose spans on literal cases."""

from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.operators import images as M


def test_queue_and_labels(spark):
    queue = spark.createDataFrame([("i1", "d1"), ("i2", "d1")], "image_id string, parent string")
    found = spark.createDataFrame([("i2", "d1"), ("i3", "d2"), ("i3", "d2")], "image_id string, parent string")
    q = M.register(queue, found)
    assert sorted(r.image_id for r in q.collect()) == ["i1", "i2", "i3"]
    history = spark.createDataFrame([("i1", 1, "old", False), ("i1", 2, "new", False), ("i2", 1, "x", True), (None, 9, "z", False)], "image_id string, at int, tag string, ignored boolean")
    merged = {r.image_id: r for r in M.merge_labels(q, history).collect()}
    assert merged["i1"].tag == "new" and merged["i1"].labeled and not merged["i2"].labeled and merged["i2"].ignored and not merged["i3"].labeled
    counts = {r.parent: (r.total, r.unlabeled, r.missing) for r in M.counters(M.merge_labels(q, history), "parent", F.col("labeled"), F.col("tag").isNotNull()).collect()}
    assert counts == {"d1": (2, 1, 0), "d2": (1, 1, 1)}
    assert [r.image_id for r in M.work_order(M.merge_labels(q, history)).collect()] == ["i2", "i3", "i1"]


def test_tag_union(spark):
    df = spark.createDataFrame([("d", "#B b"), ("d", "a"), ("d", "A "), ("d", None), ("e", " ")], "parent string, t string")
    assert [(r.parent, r.tags) for r in M.tag_union(df, "parent", F.col("t")).collect()] == [("d", ["a", "b_b"])]


def test_loose_position_and_best(spark):
    df = spark.createDataFrame([("서버 로그를 먼저 확인", "로그 서버"), ("none here", "로그"), (None, "a"), ("a b", "")], "s string, p string")
    assert [r[0] for r in df.select(X.loose_position(F.col("s"), F.col("p"))).collect()] == [0, -1, -1, -1]
    assert [tuple(r) for r in spark.createDataFrame([(1.0, 2.0), (1.0, 0.0)], "a double, b double").select(X.over_best(F.col("a"), F.col("b"))).collect()] == [(0.5,), (1.0,)]


def test_payload_with_queue(spark):
    payload = spark.createDataFrame([("i1", "d1"), ("i2", "d1"), ("i2", "d1"), (None, "d1"), ("i5", None)], "image_id string, doc_id string")
    queue = spark.createDataFrame([("i2", "other"), ("i3", "d2"), ("i3", "d2"), (None, "d3")], "image_id string, parent_doc_id string")
    got = {r.doc_id: (r.n_payload, r.n_queued, r.n_both) for r in M.payload_with_queue(payload, queue).collect()}
    assert got == {"d1": (2, 1, 1), "d2": (0, 1, 0), None: (1, 0, 0)}
    assert M.payload_with_queue(payload.limit(0), queue.limit(0)).count() == 0
