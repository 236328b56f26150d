"""Queries of the training-data problems, over the tables of a data directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.llm import canonical, encoding, frequency, language, leakage, pairs, quality, splitting
from lexloom.session import spread, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list item of every entity, and whether its name or an alias told it."""
    return canonical.map_entities(table(spark, sf_dir, "entities"), table(spark, sf_dir, "canonical_names"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list item of every entity, 0 where it means none."""
    return p1_matches(spark, sf_dir).select("entity_id", "canon_id")


def p1_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries of the list within the distance of each distinct typed value."""
    return canonical.candidate_entries(table(spark, sf_dir, "entities"), table(spark, sf_dir, "canonical_names"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks over the cap and whether natural boundaries suffice to cut them."""
    return p2_pieces(spark, sf_dir).where("piece_no = 0").select("chunk_id", "cut_kind")


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces themselves, with their offsets in the chunk's text."""
    chunks = table(spark, sf_dir, "chunks").where(F.length("text") > 1024)
    distinct = splitting.latest_rows(chunks, "chunk_id", "ingested_at", ["text", "section_path"])
    return splitting.split_oversized(distinct, ["chunk_id"], carry=("section_path",)).withColumnsRenamed({"piece_start": "start_offset", "piece_end": "end_offset"})


def p2_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every cut chunk what its pieces give together: whether all are within the cap and share 120 characters with their neighbours, and the text put together again."""
    pieces = p2_pieces(spark, sf_dir).withColumn("before", F.lag("end_offset").over(W.partitionBy("chunk_id").orderBy("piece_no")))
    shared = F.coalesce(F.col("before") - F.col("start_offset") == 120, F.col("start_offset") == 0)
    fresh = F.when(F.col("piece_no") == 0, F.col("piece_text")).otherwise(F.expr("substring(piece_text, 121)"))
    exact = F.length("piece_text") == F.col("end_offset") - F.col("start_offset")
    parts = F.array_sort(F.collect_list(F.struct("piece_no", fresh.alias("t"))))  # the pieces of one chunk, as long as its text
    text = F.array_join(F.transform(parts, lambda x: x["t"]), "")
    return pieces.groupBy("chunk_id").agg(F.md5(text.cast("binary")).alias("text_md5"), F.max("end_offset").alias("n_chars"), F.every(F.length("piece_text") <= 1024).alias("within"), F.every(shared).alias("shared"), F.every(exact).alias("exact"))


def p3_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and document frequency of every distinct term of the corpus."""
    return frequency.term_frequencies(table(spark, sf_dir, "corpus"), order_col="ingested_at")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that are too rare or too common to be useful."""
    return p3_terms(spark, sf_dir).where(F.col("mark").isNotNull()).select("term", "mark")


def p4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main language of records without a right label, and the language of each line of mixed records, with confidence."""
    corpus = table(spark, sf_dir, "corpus")
    return language.detect_languages(corpus, language.fit_ppm(corpus))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without the confidence."""
    return p4_lines(spark, sf_dir).select("doc_id", "line_no", "lang")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken entries of the question log, with the first defect that fits."""
    judge = pairs.fit_judge(table(spark, sf_dir, "corpus"))
    return pairs.broken_pairs(table(spark, sf_dir, "qna_log"), judge)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encoding.encode_documents(table(spark, sf_dir, "documents"), encoding.default_vocabulary())


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that leak an item, with the share of its wording that they hold."""
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that leak an item."""
    return p7_shares(spark, sf_dir).select("doc_id", "item_id")


def p8_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality statistics and structural kind of every document."""
    return quality.document_quality(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))  # a small file alone would be one task


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are for the most part a list, a table or junk."""
    return p8_stats(spark, sf_dir).where("kind <> 'prose'").select("doc_id", "kind")


_TERM_SQL = """
WITH records AS (
    SELECT doc_id, arg_max(text, (ingested_at, text)) AS text FROM corpus GROUP BY doc_id
), found AS (
    SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+|[가-힣]{2,}')) AS term FROM records
), counted AS (
    SELECT term, count(*) AS occurrences, count(DISTINCT doc_id) AS df FROM found
    WHERE length(term) > 1 AND NOT regexp_full_match(term, '[0-9]+') GROUP BY term
), marked AS (
    SELECT term, occurrences, df, n AS corpus_docs,
           CASE WHEN df <= 2 THEN 'rare' WHEN df > 0.2 * n THEN 'common' END AS mark
    FROM counted, (SELECT count(DISTINCT doc_id) AS n FROM corpus)
)
"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_candidates, p1_matches, p2_found, p2_pieces, p2_checked, p3_found, p3_terms, p4_found, p4_lines, p5_found, p6_ids, p7_found, p7_shares, p8_found, p8_stats)}


_OVERSIZED_SQL = r"""
WITH latest AS (
    SELECT chunk_id, max(struct_pack(ingested_at := ingested_at, text := text, section_path := section_path)).text AS text FROM chunks WHERE length(text) > 1024 GROUP BY 1
), units AS (
    SELECT chunk_id, string_split(regexp_replace(regexp_replace(text, '(\r\n|[\n\r\x0b\x0c\x{85}\x{2028}\x{2029}])', '\1' || chr(1), 'g'), '([.!?。]\s)', '\1' || chr(1), 'g'), chr(1)) AS u FROM latest
)
SELECT chunk_id, CASE WHEN list_max(list_transform(u, lambda x: length(x))) > 1024 - 120 THEN 'forced' ELSE 'natural' END AS cut_kind FROM units
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _OVERSIZED_SQL,
        "p2_checked": "SELECT chunk_id, md5(text) AS text_md5, length(text) AS n_chars, true AS within, true AS shared, true AS exact FROM (SELECT chunk_id, max(struct_pack(ingested_at := ingested_at, text := text, section_path := section_path)).text AS text FROM chunks WHERE length(text) > 1024 GROUP BY 1)",
        "p3_found": _TERM_SQL + "SELECT term, mark FROM marked WHERE mark IS NOT NULL",
        "p3_terms": _TERM_SQL + "SELECT * FROM marked",
    }
