"""Problem 2: oversized texts cut into pieces at natural boundaries, with overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Levels of the separator hierarchy, coarsest first; each pattern ends where a cut may fall.
_SECTION = re.compile(r"(?:\r\n|[\n\r\f])[ \t]*(?=#{1,6} |\[[^\]\n]{1,60}\][ \t]*[\r\n]|Step \d|\d+(?:\.\d+)+[ .)])|\f")
_PARAGRAPH = re.compile(r"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)\s*")
_LINE = re.compile(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_SENTENCE = re.compile(r"[.!?。](?=\s)\s?")
_WORD = re.compile(r"\s+")
_LEVELS = (_SECTION, _PARAGRAPH, _LINE, _SENTENCE, _WORD)
_NATURAL = 4  # levels before this one are natural boundaries


def _units(text: str, start: int, stop: int, most: int, level: int = 0) -> Iterator[tuple[int, bool]]:
    """Ends of units of at most ``most`` characters in text[start:stop], and whether each end is a natural one."""
    if stop - start <= most:
        yield stop, level <= _NATURAL
        return
    if level == len(_LEVELS):
        for end in range(start + most, stop, most):
            yield end, False
        yield stop, False
        return
    at = start
    for m in _LEVELS[level].finditer(text, start, stop):
        if at < m.end() < stop:
            yield from _units(text, at, m.end(), most, level + 1)
            at = m.end()
    yield from _units(text, at, stop, most, level + 1)


def split_text(text: str, limit: int, overlap: int) -> tuple[list[tuple[int, int]], bool]:
    """Pieces as (start, end), each within ``limit``, neighbours sharing ``overlap`` characters; and whether all cuts are natural.

    Units come from the recursive hierarchy section, paragraph, line,
    sentence, word, character; they are packed greedily.  Each piece after
    the first begins ``overlap`` characters before the end of its
    predecessor, so a unit may have ``limit - overlap`` characters.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    if len(text) <= limit:
        return [(0, len(text))], True
    pieces, start, held, natural = [], 0, 0, True
    for end, good in _units(text, 0, len(text), limit - overlap):
        if end - start > limit:
            pieces.append((start, held))
            start = max(0, held - overlap)
        natural, held = natural and (good or end == len(text)), end
    pieces.append((start, held))
    return pieces, natural


def _cut(texts: list[str | None], limit: int, overlap: int):
    for t in texts:
        yield None if t is None else split_text(t, limit, overlap)


def split_oversized(df: DataFrame, keys: list[str], text_col: str = "text", limit: int = 1024, overlap: int = 120, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pieces of the texts longer than ``limit`` code points.

    Result: ``keys``, ``carry``, piece_no, piece_text, piece_start, piece_end
    (offsets in the text), cut_kind.  ``natural`` if paragraph, line and
    sentence ends sufficed, else ``forced``.  Null and shorter texts give no
    row; a row that occurs twice is cut twice (drop duplicates before).  Other
    columns of the input are not read.  No shuffle: the filter runs in the
    scan and only long texts reach Python.
    """
    cols = [*keys, *carry]
    src = df.where(F.length(text_col) > limit).select(*cols, F.col(text_col).alias("_text"))
    schema = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(cols)).to_pylist()
            rows, out = [], {"piece_no": [], "piece_text": [], "piece_start": [], "piece_end": [], "cut_kind": []}
            for i, (pieces, natural) in enumerate(_cut(texts, limit, overlap)):
                for k, (a, b) in enumerate(pieces):
                    rows.append(i)
                    for c, v in zip(out, (k, texts[i][a:b], a, b, "natural" if natural else "forced")):
                        out[c].append(v)
            if rows:
                kept = batch.select(cols).take(pa.array(rows))
                kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(v, t) for v, t in zip(out.values(), kinds))], names=[*cols, *out])

    return src.mapInArrow(run, f"{schema}, piece_no int, piece_text string, piece_start int, piece_end int, cut_kind string")


def latest_rows(df: DataFrame, key: str, order: str, cols: list[str]) -> DataFrame:
    """One row of ``cols`` per ``key``: the latest by ``order``, ties by the greatest values."""
    best = F.max(F.struct(F.col(order), *[F.col(c) for c in cols])).alias("_best")
    return df.groupBy(key).agg(best).select(key, *[F.col(f"_best.{c}").alias(c) for c in cols])
