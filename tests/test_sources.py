"""Readers, sinks and streams on files made here."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from lexloom.sources import readers as R
from lexloom.sources import sinks
from lexloom.streaming import ingest as I


def office(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


W = 'xmlns:w="urn:w"'
DOCX = office({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t>world</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>", "docProps/core.xml": '<c xmlns:dc="urn:dc"><dc:title>My title</dc:title><dc:created>2024-01-01</dc:created></c>', "word/media/image1.png": "x"})
PPTX = office({f"ppt/slides/slide{n}.xml": f'<sld xmlns:a="urn:a"><a:p><a:r><a:t>slide {n}</a:t></a:r></a:p></sld>' for n in (10, 2)})
XLSX = office({"xl/sharedStrings.xml": "<sst><si><t>key</t></si><si><t>값</t></si></sst>", "xl/worksheets/sheet1.xml": '<s><row><c t="s"><v>0</v></c><c t="s"><v>1</v></c></row><row><c><v>3</v></c><c><v>4.5</v></c></row><row></row></s>'})


def test_directory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in {"a.docx": DOCX, "sub/b.pptx": PPTX, "c.xlsx": XLSX, "d.txt": "x \n\n y".encode(), "e.md": "가나".encode("cp949"), "f.pdf": b"%PDF", "g.docx": b"broken", "h.png": b"p", "i.bin": b"?"}.items():
        (tmp_path / name).write_bytes(data)
    kinds = {r.path.rpartition("/")[2]: r.kind for r in R.scan_directory(spark, str(tmp_path)).collect()}
    assert kinds["h.png"] == "image" and kinds["a.docx"] == "document" and "i.bin" not in kinds
    got = {r.path.rpartition("/")[2]: r for r in R.read_documents(spark, str(tmp_path), {"pdf": lambda b: ["from hook"]}).collect()}
    assert got["a.docx"].text == "Hello world\na | b" and got["a.docx"].title == "My title" and got["a.docx"].n_images == 1
    assert got["b.pptx"].text == "slide 2\nslide 10" and got["b.pptx"].title == "b"
    assert got["c.xlsx"].text == "key | 값\n3 | 4.5" and got["d.txt"].text == "x\ny" and got["e.md"].text == "가나"
    assert got["f.pdf"].text == "from hook" and got["g.docx"].error and got["g.docx"].text == "" and len(got["d.txt"].file_id) == 16
    again = {r.path.rpartition("/")[2]: r.file_id for r in R.scan_directory(spark, str(tmp_path)).collect()}
    assert again["d.txt"] == got["d.txt"].file_id


def test_benchmark_files(spark, tmp_path):
    (tmp_path / "corpus.jsonl").write_text('{"_id": "1", "title": "T", "text": "x"}\n\nbroken\n{"id": "2", "text": null}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "q1", "text": "a"}\n{"id": "q2", "query": "b"}\n{"_id": "q3", "text": "c"}\n')
    (tmp_path / "qrels.tsv").write_text("query-id\tcorpus-id\tscore\nq1\t1\t2\nq2\t2\t1\nq9\n")
    corpus = {r.doc_id: (r.title, r.text) for r in R.benchmark_corpus(spark, str(tmp_path / "corpus.jsonl")).collect()}
    assert corpus == {"1": ("T", "x"), "2": ("", "")}
    qrels = R.benchmark_qrels(spark, str(tmp_path / "qrels.tsv"))
    assert {(r.qid, r.doc_id, r.rel) for r in qrels.collect()} == {("q1", "1", 2), ("q2", "2", 1)}
    assert {(r.qid, r.text) for r in R.benchmark_queries(spark, str(tmp_path / "queries.jsonl"), qrels).collect()} == {("q1", "a"), ("q2", "b")}
    raw = spark.createDataFrame([("d1", "t1", "q1", "?", "yes"), ("d1", "t2", "q2", "?", "UNANSWERABLE")], "document_id string, document_extracted string, question_id string, question string, answer string")
    c, q, r = R.question_benchmark(raw)
    assert [x.text for x in c.collect()] == ["t1"] and q.count() == 2 and [x.qid for x in r.collect()] == ["q1"]
    df = spark.createDataFrame([(199, 3), (200, 1), (100, 2), (None, None)], "chars int, pages int")
    assert [x[0] for x in df.select(R.has_text_layer(F.col("chars"), F.col("pages"))).collect()] == [True, True, True, False]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, kw string")
    sinks.append_json(df, str(tmp_path / "log"))
    sinks.append_json(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    sinks.write_json(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    sinks.keyword_sample(df, str(tmp_path / "sample"), 1)
    assert spark.read.json(str(tmp_path / "sample")).count() == 1
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["doc_id", "kw"]
    for _ in range(2):
        sinks.partition_append(df, str(tmp_path / "parts"), 7)
    assert spark.read.parquet(str(tmp_path / "parts")).count() == 2
    a = spark.createDataFrame([("r1", 1.0)], "run string, v double")
    b = spark.createDataFrame([("r1", 9.0), ("r2", 2.0)], "run string, v double")
    assert {tuple(r) for r in sinks.merge_metrics(a, b, ["run"]).collect()} == {("r1", 1.0), ("r2", 2.0)}


def write(path, rows):
    path.parent.mkdir(exist_ok=True)
    path.write_text("\n".join(json.dumps(r) for r in rows))


def test_df_state(spark, tmp_path):
    write(tmp_path / "in/1.json", [{"doc_id": "a", "text": "log queue"}, {"doc_id": "b", "text": "log"}, {"doc_id": "a", "text": "log queue"}])
    run = lambda: I.run_df_state(spark.readStream.schema("doc_id string, text string").json(str(tmp_path / "in")), str(tmp_path / "state"), str(tmp_path / "cp"))
    run()
    write(tmp_path / "in/2.json", [{"doc_id": "b", "text": "log"}, {"doc_id": "c", "text": "queue new"}])
    run()
    run()
    assert {r.term: r.df for r in I.read_df_state(spark, str(tmp_path / "state")).collect()} == {"log": 2, "queue": 2, "new": 1}


def test_entity_status(spark, tmp_path):
    write(tmp_path / "in/1.json", [{"e": "x", "at": "2024-01-01 00:00:00", "kind": "issue"}, {"e": "y", "at": "2024-01-01 00:00:00", "kind": "view"}])
    query = lambda: I.entity_status(spark.readStream.schema("e string, at string, kind string").json(str(tmp_path / "in")), "e", "at", "kind").writeStream.outputMode("update").foreachBatch(lambda df, n: sinks.partition_append(df, str(tmp_path / "out"), n)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    query()
    write(tmp_path / "in/2.json", [{"e": "x", "at": "2024-01-02 00:00:00", "kind": "resolution"}, {"e": "x", "at": "2023-01-01 00:00:00", "kind": "issue"}])
    query()
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.entity, r.status, r.n_events) for r in out} == {("x", "active", 1), ("y", "unknown", 1), ("x", "unknown", 3)}


def test_windows_and_late_votes(spark, tmp_path):
    write(tmp_path / "in/1.json", [{"ts": "2024-01-01T10:00:00Z", "feedback": "like"}, {"ts": "2024-01-01T11:00:00Z", "feedback": "like"}, {"ts": "2024-01-03T00:00:00Z", "feedback": "dislike"}])
    stream = spark.readStream.schema("ts timestamp, feedback string").json(str(tmp_path / "in"))
    q = I.windowed_feedback(stream).writeStream.outputMode("append").format("memory").queryName("votes").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.feedback, r.n) for r in spark.table("votes").collect()] == [("like", 2)]
    assert I.new_documents(stream, "feedback", "ts").isStreaming


def test_images_inside_files(spark, tmp_path):
    rels = '<Relationships><Relationship Target="../media/image2.png"/></Relationships>'
    shown = office({"ppt/slides/_rels/slide3.xml.rels": rels, "ppt/slides/_rels/slide12.xml.rels": rels, "ppt/media/image2.png": "abc", "ppt/media/image1.png": "d"})
    for name, data in {"a.docx": DOCX, "b.pptx": shown, "c.xlsx": XLSX, "g.docx": b"broken", "d.txt": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    got = {(r.path.rpartition("/")[2], r.image_name): (r.slide_index, r.size, bytes(r.content)) for r in R.read_images(spark, str(tmp_path)).collect()}
    assert got == {("a.docx", "image1.png"): (None, 1, b"x"), ("b.pptx", "image2.png"): (3, 3, b"abc"), ("b.pptx", "image1.png"): (None, 1, b"d")}


def test_json_documents_and_overwrite(spark, tmp_path):
    sinks.write_json(spark.createDataFrame([(1, "a")], "doc_id int, t string"), str(tmp_path / "o"))
    sinks.write_json(spark.createDataFrame([(2, "b")], "doc_id int, t string"), str(tmp_path / "o"))
    assert [(r.doc_id, r.t) for r in spark.read.json(str(tmp_path / "o")).collect()] == [(2, "b")]
