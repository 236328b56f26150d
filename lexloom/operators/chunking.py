"""Chunking of documents into packed paragraphs, and what is derived from chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CHARS = 1024
_PARAGRAPH = re.compile(r"\n\s*\n+")
_SENTENCE = re.compile(r"(?<=[.!?。])\s+|\n+")
#: Where a new unit starts, by genre; all markers count.
_MARKERS = {
    "procedure": re.compile(r"\n\s*(?=\d+[.)]\s|(?i:step)\s+\d|단계\s*\d|[가-힣]\.\s)"),
    "report": re.compile(r"\n\s*(?=#{1,3}\s|제\s*\d+\s*장|(?i:chapter)\s+\d)"),
    "issue": re.compile(r"\n\s*(?=(?:문제|현상|증상|오류|장애|원인|원인 ?분석|해결|조치|대응|수정|(?i:problem|issue|error|cause|root cause|solution|resolution|fix))[:：])"),
}
#: Factors on the target and least size, by genre.
_SCALE = {"procedure": (0.7, 0.8), "report": (1.3, 1.2)}


def _spans(text: str, pattern: re.Pattern, start: int = 0, stop: int | None = None) -> list[tuple[int, int]]:
    """Non-blank stretches between the matches."""
    stop, at, out = len(text) if stop is None else stop, start, []
    for m in pattern.finditer(text, start, stop):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, stop))
    return [(a, b) for a, b in out if text[a:b].strip()]


def pack(text: str, target: int = 512, least: int = 128, overlap: int = 96, genre: str | None = None, topic: frozenset[str] = frozenset(), compat: bool = False) -> list[tuple[int, int, str]]:
    """Chunks (start, end, text) of a normalised text; no part of it is lost.

    Units come from the genre's markers (paragraphs where there are none) and
    long ones are split at sentences; they are packed up to the target, a
    short chunk takes the next unit as long as 1,024 characters allow, and a
    unit with a word of the topic starts a new chunk once the chunk is long
    enough.  Each chunk after the first is preceded by the end of the chunk
    before it; offsets don't count that.

    ``compat`` loses what the described packer loses: a chunk that is long
    enough but under 1,024 characters is overwritten by the next unit.
    """
    f, g = _SCALE.get(genre or "", (1.0, 1.0))
    target, least = int(target * f), int(least * g)
    units = _spans(text, _MARKERS[genre]) if genre in _MARKERS else []
    if len(units) <= 1:
        units = _spans(text, _PARAGRAPH)
    fine: list[tuple[int, int]] = []
    for a, b in units:
        fine.extend(_spans(text, _SENTENCE, a, b) if b - a > target * 1.5 else [(a, b)])
    out: list[list[int]] = []
    for a, b in fine:
        if out:
            size = out[-1][1] - out[-1][0]
            joined = b - out[-1][0]
            fresh = topic and size >= least and any(w in text[a:b].lower() for w in topic)
            if not fresh and (joined <= min(target, MAX_CHARS) or (size < least and joined <= MAX_CHARS)):
                out[-1][1] = b
                continue
            if compat and not fresh and least <= size < MAX_CHARS:
                out[-1] = [a, b]
                continue
        out.append([a, b])
    bodies = [text[a:b].strip() for a, b in out]
    return [(a, b, (bodies[i - 1][-overlap:] + "\n\n" + bodies[i]) if i and overlap else bodies[i]) for i, (a, b) in enumerate(out)]


def size_policy(n: Column) -> Column:
    """Target, least size and overlap for a text of ``n`` characters."""
    small = F.struct(F.least(F.lit(256), F.floor(n / 2)).cast("int").alias("target"), F.least(F.lit(64), F.floor(n / 4)).cast("int").alias("least"), F.lit(48).alias("overlap"))
    large = F.struct(F.lit(768).alias("target"), F.lit(256).alias("least"), F.lit(128).alias("overlap"))
    plain = F.struct(F.lit(512).alias("target"), F.lit(128).alias("least"), F.lit(96).alias("overlap"))
    return F.when(n < 500, small).when(n > 10_000, large).otherwise(plain)


def chunk_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, start_offset, end_offset, text, section_path) of (doc_id, text, genre, topic array).

    Sizes follow :func:`size_policy`; null and blank texts have no chunk.  One
    pass without a shuffle, as packing is sequential within a document only.
    """
    policy = size_policy(F.length("text"))
    src = docs.where(F.length(F.trim("text")) > 0).select(F.col("doc_id").alias("_id"), "text", F.coalesce("genre", F.lit("unknown")).alias("genre"), "topic", policy.target.alias("target"), policy.least.alias("least"), policy.overlap.alias("overlap"))
    kind = src.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, texts, genres, topics, targets, leasts, overlaps = (c.to_pylist() for c in batch.columns)
            rows, cols = [], ([], [], [], [], [])
            for i, t in enumerate(texts):
                for k, (a, b, piece) in enumerate(pack(t, targets[i], leasts[i], overlaps[i], genres[i], frozenset(topics[i] or ()))):
                    rows.append(i)
                    for c, v in zip(cols, (k, a, b, piece, genres[i])):
                        c.append(v)
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["doc_id", "chunk_index", "start_offset", "end_offset", "text", "section_path"])

    return src.mapInArrow(run, f"doc_id {kind}, chunk_index int, start_offset int, end_offset int, text string, section_path string")


def markdown_chunks(text: str, most: int = 1400, least: int = 180) -> list[str]:
    """Paragraphs packed up to ``most`` characters; a chunk under ``least`` goes to the one before."""
    out: list[str] = []
    for a, b in _spans(text, _PARAGRAPH):
        p = text[a:b].strip()
        if out and len(out[-1]) + 2 + len(p) <= most:
            out[-1] += "\n\n" + p
        else:
            out.append(p)
    merged: list[str] = []
    for c in out:
        if merged and len(c) < least:
            merged[-1] += "\n\n" + c
        else:
            merged.append(c)
    return merged


def chunk_markdown(docs: DataFrame, most: int = 1400, least: int = 180) -> DataFrame:
    """(doc_id, chunk_index, text): :func:`markdown_chunks` of (doc_id, text); null and blank texts have no chunk."""
    src = docs.where(F.length(F.trim("text")) > 0).select(F.col("doc_id").alias("_id"), "text")
    kind = src.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = [(i, k, p) for i, t in enumerate(batch.column(1).to_pylist()) for k, p in enumerate(markdown_chunks(t, most, least))]
            rows, numbers, texts = zip(*pieces) if pieces else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], names=["doc_id", "chunk_index", "text"])

    return src.mapInArrow(run, f"doc_id {kind}, chunk_index int, text string")


def chunk_report(chunks: DataFrame) -> DataFrame:
    """(doc_id, n_chunks, mean_chars, longest, n_quoted, mapping_rate) of (doc_id, chunk_id, text, quoted boolean)."""
    n = F.count("*")
    return chunks.groupBy("doc_id").agg(n.alias("n_chunks"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"), F.max(F.length("text")).alias("longest"), F.sum(F.col("quoted").cast("int")).alias("n_quoted"), F.round(F.sum(F.col("quoted").cast("int")) / n, 6).alias("mapping_rate"))
