"""Text scalars over whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.functions.constants import SYNONYMS
from lexloom.session import table


def _documents(spark, d):
    return table(spark, d, "documents")


def tokenize_simple(spark, d):
    """Retrieval tokens of every document."""
    tokens = X.simple_tokens(F.col("text"))
    return _documents(spark, d).select("doc_id", F.array_join(tokens, " ").alias("tokens"), F.size(tokens).alias("n_tokens"))


def tokenize_tagging(spark, d):
    """Tagging tokens of every document, synonyms folded."""
    tokens = X.tagging_tokens(F.col("text"))
    return _documents(spark, d).select("doc_id", F.array_join(tokens, " ").alias("tokens"), F.size(tokens).alias("n_tokens"))


def language_guess(spark, d):
    """Documents by declared and guessed language."""
    return _documents(spark, d).groupBy(F.coalesce("lang", F.lit("none")).alias("declared"), X.guess_language(F.col("text")).alias("guessed")).agg(F.count("*").alias("n"))


def normalize_text(spark, d):
    """Normalised text of every document."""
    return _documents(spark, d).select("doc_id", X.normalize_text(F.col("text")).alias("normalized"))


def normalize_key(spark, d):
    """Keys under which the spellings of entity names meet."""
    return table(spark, d, "entities").groupBy(X.normalize_key(F.coalesce("name", F.lit(""))).alias("norm_key")).agg(F.count("*").alias("n"))


def clean_lines(spark, d):
    """Documents without short and repeated lines."""
    return _documents(spark, d).select("doc_id", X.clean_lines(F.col("text")).alias("cleaned"))


def clean_controls(spark, d):
    """Chunks without control characters."""
    cleaned = X.clean_controls(F.col("text"))
    return table(spark, d, "chunks").groupBy("chunk_id").agg(F.max(cleaned).alias("cleaned"))


def ascii_ratio(spark, d):
    """Documents under 80 % ASCII by source."""
    ratio = X.ascii_ratio(F.col("text"))
    return _documents(spark, d).where(F.col("text").isNotNull()).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.when(ratio < 0.8, 1).otherwise(0)).alias("n_foreign"), F.round(F.min(ratio), 6).alias("least_ratio"))


def stable_ids(spark, d):
    """Deterministic keys of every document."""
    c = F.col
    return _documents(spark, d).select(
        "doc_id",
        X.id_hash("a_", 16, c("source"), c("n_chars")).alias("artifact_id"),
        X.id_hash("e_", 16, F.lower(X.trim_space(c("doc_type"))), F.lower(X.trim_space(c("title")))).alias("entity_id"),
        X.id_hash("c_", 16, c("doc_id"), F.lit(0), c("n_chars")).alias("chunk_id"),
        X.record_key(c("title"), c("text")).alias("record_key"),
    )


def tag_normalization(spark, d):
    """Sorted tag line of every document from its free-form fields."""
    csv = F.concat_ws(",", "genre", F.concat(F.lit(" #"), F.col("source")), F.upper("genre"), F.col("doc_type"), F.upper("doc_type"))
    return _documents(spark, d).select("doc_id", X.hashtag_line(X.normalize_tags(csv)).alias("tag_line"))


def file_names(spark, d):
    """File name and slug of every title."""
    return _documents(spark, d).select("doc_id", X.safe_filename(F.col("title")).alias("file_name"), X.slug(F.col("title")).alias("slug"))


def evidence_snippets(spark, d):
    """The first three places of a word with the text around them, in every document that has it."""
    t = F.col("text")
    spans = X.positions(t, "server", 3)
    found = _documents(spark, d).where(F.lower(t).contains("server"))
    return found.select("doc_id", F.array_join(F.transform(spans, lambda p: p.cast("string")), ",").alias("starts"), F.array_join(X.snippets(t, spans, 6), " ~ ").alias("snippets"))


_KEYS = [(alias, canonical) for alias, canonical in X.synonym_map().items()]
_SYNONYM_SQL = "MAP {" + ", ".join(f"'{a}': '{c}'" for a, c in _KEYS) + "}"
SIMPLE_SQL = r"list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z0-9]{{2,}}'))"
TAGGING_SQL = (
    r"list_transform(list_filter(list_transform(regexp_extract_all(coalesce({0}, ''), '[A-Za-z0-9_]+|[가-힣]{{2,}}'), lambda t: lower(t)), lambda t: length(t) >= 2 AND NOT regexp_full_match(t, '[0-9]+')), "
    "lambda t: coalesce(" + _SYNONYM_SQL.replace("{", "{{").replace("}", "}}") + "[t], t))"
)
_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
NORMAL_SQL = _TRIM.format(r"regexp_replace(regexp_replace(regexp_replace({0}, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")

QUERIES = {f.__name__: f for f in (tokenize_simple, tokenize_tagging, language_guess, normalize_text, normalize_key, clean_lines, clean_controls, ascii_ratio, stable_ids, tag_normalization, file_names, evidence_snippets)}

ORACLE = {
    "tokenize_simple": f"SELECT doc_id, array_to_string({SIMPLE_SQL.format('text')}, ' ') AS tokens, len({SIMPLE_SQL.format('text')}) AS n_tokens FROM documents",
    "tokenize_tagging": f"SELECT doc_id, array_to_string({TAGGING_SQL.format('text')}, ' ') AS tokens, len({TAGGING_SQL.format('text')}) AS n_tokens FROM documents",
    "language_guess": "SELECT coalesce(lang, 'none') AS declared, CASE WHEN regexp_matches(text, '[가-힣]') THEN 'ko' WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'unknown' END AS guessed, count(*) AS n FROM documents GROUP BY 1, 2",
    "normalize_text": f"SELECT doc_id, {NORMAL_SQL.format('text')} AS normalized FROM documents",
    "normalize_key": r"""
        SELECT regexp_replace(regexp_replace(replace(lower(regexp_replace(regexp_replace(regexp_replace(coalesce(name, ''), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'),
               '^[.,;:!?()\[\]{}"''\-]+|[.,;:!?()\[\]{}"''\-]+$', '', 'g')), '_', ' '), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS norm_key, count(*) AS n
        FROM entities GROUP BY 1""",
    "clean_lines": r"""
        WITH kept AS (
            SELECT doc_id, text IS NULL AS missing,
                   list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\r\n|\r|\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 1 AND NOT regexp_full_match(x, '[0-9]{1,3}')) AS lines
            FROM documents
        ), joined AS (
            SELECT doc_id, missing, array_to_string(list_filter(lines, lambda x, i: list_position(lines, x) = i), chr(10)) AS t FROM kept
        )
        SELECT doc_id, CASE WHEN missing THEN NULL ELSE t END AS cleaned FROM joined""",
    "clean_controls": r"""
        WITH t AS (
            SELECT chunk_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\n\r\t]', ' ', 'g'), '\p{C}', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS c FROM chunks
        )
        SELECT chunk_id, max(CASE WHEN length(c) >= 10 THEN c ELSE '' END) AS cleaned FROM t GROUP BY 1""",
    "ascii_ratio": r"""
        WITH r AS (SELECT source, CASE WHEN length(text) = 0 THEN 1.0 ELSE length(regexp_replace(text, '[^\x00-\x7F]', '', 'g'))::DOUBLE / length(text) END AS ratio FROM documents WHERE text IS NOT NULL)
        SELECT source, count(*) AS n, sum(CASE WHEN ratio < 0.8 THEN 1 ELSE 0 END)::BIGINT AS n_foreign, round(min(ratio), 6) AS least_ratio FROM r GROUP BY 1""",
    "stable_ids": rf"""
        SELECT doc_id,
               'a_' || left(sha256(coalesce(source, '') || '|' || n_chars), 16) AS artifact_id,
               'e_' || left(sha256(lower(coalesce({_TRIM.format('doc_type')}, '')) || '|' || lower(coalesce({_TRIM.format('title')}, ''))), 16) AS entity_id,
               'c_' || left(sha256(doc_id || '|0|' || n_chars), 16) AS chunk_id,
               'rk_' || left(sha256(lower({_TRIM.format("coalesce(title, '')")}) || '|' || lower({NORMAL_SQL.format("coalesce(text, '')")})), 24) AS record_key
        FROM documents""",
    "tag_normalization": r"""
        WITH c AS (SELECT doc_id, concat_ws(',', genre, ' #' || source, upper(genre), doc_type, upper(doc_type)) AS csv FROM documents)
        SELECT doc_id, array_to_string(list_transform(list_sort(list_distinct(list_filter(list_transform(string_split(csv, ','), lambda t: lower(regexp_replace(regexp_replace(regexp_replace(t, '^\s+|\s+$', '', 'g'), '^#', ''), '\s+', '_', 'g'))), lambda t: t <> ''))), lambda t: '#' || t), ' ') AS tag_line
        FROM c""",
    "file_names": r"""
        SELECT doc_id, replace(regexp_replace(regexp_replace(left(title, 20), '[^\p{L}\p{N} _\-]', '', 'g'), '^\s+|\s+$', '', 'g'), ' ', '_') AS file_name,
               left(regexp_replace(regexp_replace(lower(title), '[^0-9a-z가-힣]+', '-', 'g'), '^-+|-+$', '', 'g'), 40) AS slug FROM documents""",
    "evidence_snippets": """
        WITH p AS (
            SELECT doc_id, text, string_split(lower(text), 'server') AS parts FROM documents WHERE contains(lower(text), 'server')
        ), s AS (
            SELECT doc_id, text, list_transform(range(1, least(len(parts) - 1, 3) + 1), lambda i: list_sum(list_transform(parts[1:i], lambda x: length(x)))::BIGINT + (i - 1) * 6) AS starts FROM p
        )
        SELECT doc_id, array_to_string(starts, ',') AS starts, array_to_string(list_transform(starts, lambda p: substring(text, greatest(p - 20, 0) + 1, least(p, 20) + 26)), ' ~ ') AS snippets FROM s""",
}
