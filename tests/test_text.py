"""Text scalars on literal cases."""

from pyspark.sql import functions as F

from lexloom.functions import text as X


def values(spark, texts, *exprs):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *[e.alias(f"e{k}") for k, e in enumerate(exprs)]).orderBy("i").collect()]


def test_simple_tokens(spark):
    got = values(spark, ["lété été a1 b c_d 42 ÀB", None, "", "Hi, hi HI!"], X.simple_tokens(F.col("t")))
    assert [x[0] for x in got] == [["a1", "42"], [], [], ["hi", "hi", "hi"]]


def test_tagging_tokens(spark):
    got = values(spark, ["오류 발생 Error_1 12 a 조치", None, "설정 postgres PG"], X.tagging_tokens(F.col("t")))
    assert [x[0] for x in got] == [["issue", "발생", "error_1", "resolution"], [], ["procedure", "postgresql", "postgresql"]]


def test_synonyms_keep_the_first_claim():
    table = X.synonym_map()
    assert table["설정"] == "procedure" and table["조치"] == "resolution" and table["webtob"] == "webtob"


def test_normalisation(spark):
    got = values(spark, [" a\t b\r\nc\n\n\n\nd ", None, "\t\n"], X.normalize_text(F.col("t")))
    assert [x[0] for x in got] == ["a b\nc\n\nd", None, ""]
    got = values(spark, ["  (Kafka_Cluster),  x -", " 'A  b' ", None], X.normalize_key(F.col("t")))
    assert [x[0] for x in got] == ["kafka cluster), x", "a b", None]
    got = values(spark, ["#B, a ,,b, A b", None], X.normalize_tags(F.col("t")), X.hashtag_line(X.normalize_tags(F.col("t"))))
    assert got == [(["a", "a_b", "b"], "#a #a_b #b"), ([], "")]


def test_lines_and_controls(spark):
    got = values(spark, ["ab\n ab \n1\n123\n1234\nx", None], X.clean_lines(F.col("t")))
    assert [x[0] for x in got] == ["ab\n1234", None]
    long = "\n".join(f"line number {i}" for i in range(2000))
    assert values(spark, [long], X.clean_lines(F.col("t"), 100))[0][0].endswith("...(truncated)")
    got = values(spark, ["a\x00b  c\td e f g", "short", None], X.clean_controls(F.col("t")))
    assert [x[0] for x in got] == ["a b c d e f g", "", ""]


def test_lines_are_whole_without_a_bound(spark):
    long = "\n".join(f"line number {i}" for i in range(2000))
    assert len(long) > 12_000 and values(spark, [long, None], X.clean_lines(F.col("t"))) == [(long,), (None,)]


def test_language_ascii_names(spark):
    got = values(spark, ["가 a", "abc", "12", None, ""], X.guess_language(F.col("t")), X.ascii_ratio(F.col("t")))
    assert got == [("ko", 2 / 3), ("en", 1.0), ("unknown", 1.0), ("unknown", None), ("unknown", 1.0)]
    got = values(spark, ["보고서: 2024/01 (최종)!", None], X.safe_filename(F.col("t")), X.slug(F.col("t")))
    assert got == [("보고서_202401_최종", "보고서-2024-01-최종"), (None, None)]


def test_positions_and_snippets(spark):
    text = "Server and server. SERVER server"
    got = values(spark, [text, "none", ""], X.positions(F.col("t"), "server", 3), X.snippets(F.col("t"), X.positions(F.col("t"), "server", 3), 6, 4))
    assert got[0][0] == [0, 11, 19] and got[0][1][1] == "and server. SE" and got[1][0] == [] and got[2][0] == []


def test_ids(spark):
    got = values(spark, ["x", "x", None], X.id_hash("a_", 16, F.col("t"), F.lit(1)), X.record_key(F.col("t"), F.col("t")))
    assert got[0] == got[1] != got[2] and len(got[0][0]) == 18 and len(got[0][1]) == 27


def test_jaccard(spark):
    a = F.array(F.lit("x"), F.lit("y"))
    assert values(spark, ["q"], X.jaccard(a, F.array(F.lit("y"))), X.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")))[0] == (0.5, 0.0)
