"""Problem 6: encoding of a whole corpus with a public byte-level BPE vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.pretoken import ByteBPE

_LOADED: dict[str, ByteBPE] = {}


def default_vocabulary() -> str:
    """Path of the installed byte_bpe_50k ranks."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def _bpe(path: str) -> ByteBPE:
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def _groups(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters together (a longer text stands alone)."""
    begin = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield begin, i
            begin, held = i, 0
        held += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def encode_documents(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False, batch_chars: int = 1_500_000) -> DataFrame:
    """Token ids of every row's text: ``(id_col, ids array<int>[, piece_ends array<int>])``.

    Null and empty texts give an empty list; every input row gives one output
    row (repeated rows too).  With ``offsets`` the character offset at which
    each pre-token ends comes along, so that ids can be cut at piece borders.
    No shuffle: the work is one pass over the scan; ``batch_chars`` bounds the
    memory of a task, and has no effect on the result.  ``vocab_path`` must be
    readable on the executors.
    """
    src = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(vocab_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, j in _groups(texts, batch_chars):
                ids, at, ends, firsts = bpe.encode(texts[i:j])
                cols = [batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))]
                names = [id_col, "ids"]
                if offsets:
                    cols.append(pa.ListArray.from_arrays(pa.array(firsts.astype(np.int32)), pa.array(ends)))
                    names.append("piece_ends")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return src.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>" + ", piece_ends array<int>" * offsets)


def decode_ids(df: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of token id lists: ``(id_col, text)``; a null list gives null, an empty one ''."""
    src = df.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids"))
    kind = src.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(vocab_path)
        for batch in batches:
            texts = [None if x is None else bpe.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return src.mapInArrow(run, f"`{id_col}` {kind}, text string")
