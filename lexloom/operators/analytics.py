"""Dashboard aggregates and rendered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import trim_space


def dashboard(docs: DataFrame, *by: str) -> DataFrame:
    """Documents, characters and share of empty texts by the given columns; null groups count as 'none'."""
    empty = F.coalesce(F.length(trim_space(F.col("text"))), F.lit(0)) == 0
    return docs.groupBy(*[F.coalesce(b, F.lit("none")).alias(b) for b in by]).agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("chars"), F.sum(empty.cast("int")).alias("n_empty"), F.max("modified_at").alias("last_modified"))


def histogram(values: DataFrame, column: str, width: float) -> DataFrame:
    """(bucket, n): values by multiples of ``width``; nulls are left out."""
    return values.where(F.col(column).isNotNull()).groupBy((F.floor(F.col(column) / width) * width).alias("bucket")).agg(F.count("*").alias("n"))


def confidence_bucket(c: Column) -> Column:
    """high from 0.8, mid from 0.5, else low."""
    return F.when(c >= 0.8, "high").when(c >= 0.5, "mid").otherwise("low")


def topic_groups(docs: DataFrame, column: str = "title", size: int = 50, top: int = 10) -> DataFrame:
    """The ``top`` most frequent beginnings of a text; ties by the beginning."""
    key = F.substring(trim_space(F.col(column)), 1, size)
    return docs.where(F.length(trim_space(F.col(column))) > 0).groupBy(key.alias("topic")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic").limit(top)


def cut(text: Column, most: int = 200) -> Column:
    """At most ``most`` characters, ' ...' after a cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(" ..."))).otherwise(text)


def markdown(sections: dict[str, Column]) -> Column:
    """Markdown with a heading for each section, '-' where there is nothing."""
    parts = []
    for head, body in sections.items():
        shown = trim_space(body)
        parts += [F.lit(f"## {head}"), F.when(shown.isNull() | (shown == ""), "-").otherwise(shown)]
    return F.concat_ws("\n", *parts)


def rag_rows(chunks: DataFrame) -> DataFrame:
    """(chunk_key, body): chunks with their metadata in front, keyed 'id__c0001'."""
    key = F.format_string("%s__c%04d", F.col("doc_id"), F.col("chunk_index"))
    prefix = F.concat_ws(" | ", F.concat(F.lit("title: "), F.coalesce("title", F.lit("-"))), F.concat(F.lit("genre: "), F.coalesce("genre", F.lit("-"))))
    return chunks.select(key.alias("chunk_key"), F.concat(F.lit("["), prefix, F.lit("]\n"), F.coalesce("text", F.lit(""))).alias("body"))


def front_matter(fields: dict[str, Column], body: Column) -> Column:
    """Markdown document with YAML front matter."""
    lines = [F.concat(F.lit(f"{k}: "), F.coalesce(v.cast("string"), F.lit(""))) for k, v in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"), F.coalesce(body, F.lit("")))


def viewer_filter(docs: DataFrame, genre: str | None = None, language: str | None = None, has_topic: bool | None = None, tag: str | None = None) -> DataFrame:
    """Rows of (genre, lang, topic, tags array) that pass every given filter; ``tag`` is a part of a tag in any case."""
    out = docs
    if genre is not None:
        out = out.where(F.col("genre") == genre)
    if language is not None:
        out = out.where(F.col("lang") == language)
    if has_topic is not None:
        there = F.coalesce(F.length(trim_space(F.col("topic"))) > 0, F.lit(False))
        out = out.where(there if has_topic else ~there)
    if tag:
        out = out.where(F.exists("tags", lambda t: F.contains(F.lower(t), F.lit(tag.lower()))))
    return out
