"""Sinks: append logs, tables by key, metric files and keyword samples."""

from __future__ import annotations

from pyspark.sql import DataFrame


def append_json(df: DataFrame, path: str) -> None:
    """Appends rows as JSON lines."""
    df.write.mode("append").json(path)


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines in place of what was there."""
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Rows as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def keyword_sample(keywords: DataFrame, path: str, n: int = 100) -> None:
    """Keyword lists of the first ``n`` documents."""
    write_json(keywords.orderBy("doc_id").limit(n), path)


def merge_metrics(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Stored metrics with those runs of ``fresh`` that they lack."""
    return stored.unionByName(fresh.join(stored.select(*keys).distinct(), keys, "left_anti"))


def partition_append(df: DataFrame, path: str, batch: int) -> None:
    """Writes a batch into its own partition, in place of an earlier try of the same batch, so a repeated batch leaves no double rows."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")
