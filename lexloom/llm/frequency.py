"""Problem 3: frequency of every distinct term from record-identifier bitmaps in vertical layout."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TERM = re.compile(r"[a-z0-9_]+|[가-힣]{2,}")
BUCKET = 1 << 16  # records that one container covers
ARRAY_MOST = 4096  # up to so many members a container is a sorted uint16 list, beyond it a bitmap of 8 KB


def terms_of(text: str | None) -> list[str]:
    """Terms of a text in order, repeats included: runs of ASCII letters, digits and underscores, or of two or more Hangul syllables, in the lower-cased text; single characters and pure digits are none."""
    return [t for t in TERM.findall(text.lower()) if len(t) > 1 and not t.isdigit()] if text else []


def pack(members: np.ndarray) -> bytes:
    """Container of sorted distinct uint16 members, the smaller of the two layouts."""
    if len(members) <= ARRAY_MOST:
        return members.astype("<u2").tobytes()
    bits = np.zeros(BUCKET, np.uint8)
    bits[members] = 1
    return np.packbits(bits).tobytes() + b"\0"  # the odd length tells a bitmap


def unpack(data: bytes) -> np.ndarray:
    """Members of a container."""
    if len(data) % 2:
        return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, BUCKET // 8)))
    return np.frombuffer(data, "<u2")


def union(containers: list[bytes]) -> bytes:
    """Union of containers of the same bucket."""
    if len(containers) == 1:
        return containers[0]
    return pack(np.unique(np.concatenate([unpack(c) for c in containers])))


def cardinality(data: bytes) -> int:
    """Number of members."""
    if len(data) % 2:
        return int(np.unpackbits(np.frombuffer(data, np.uint8, BUCKET // 8)).sum())
    return len(data) // 2


def term_containers(df: DataFrame, id_col: str, text_col: str, flush_pairs: int = 2_000_000) -> DataFrame:
    """Vertical layout of a collection of distinct records: term, bucket, container, occurrences.

    Records are numbered within their hash partition in the order of their
    id, so numbers are the same when a lost partition is computed again.
    Counting happens before anything is shuffled by term.
    """
    src = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).sortWithinPartitions("_id").select("_text", F.spark_partition_id().cast("long").alias("_part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, index, terms, docs, held, part = 0, {}, [], [], 0, 0

        def flush(bucket: int) -> pa.RecordBatch:
            term, doc = np.concatenate(terms), np.concatenate(docs)
            pair, count = np.unique(term * np.int64(BUCKET) + doc, return_counts=True)
            term, doc = pair // BUCKET, pair % BUCKET
            names = list(index)
            first = np.searchsorted(term, np.arange(len(names) + 1))
            occ = np.add.reduceat(count, first[:-1])
            packed = [pack(doc[a:b]) for a, b in zip(first, first[1:])]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.full(len(names), bucket)), pa.array(packed, pa.binary()), pa.array(occ.astype(np.int64))], names=["term", "bucket", "container", "occurrences"])

        for batch in batches:
            part = batch.column(1)[0].as_py() if batch.num_rows else part
            for text in batch.column(0).to_pylist():
                found = terms_of(text)
                if found:
                    terms.append(np.fromiter((index.setdefault(t, len(index)) for t in found), np.int64, len(found)))
                    docs.append(np.full(len(found), seen % BUCKET))
                    held += len(found)
                seen += 1
                if held and (held >= flush_pairs or seen % BUCKET == 0):
                    yield flush(part << 31 | (seen - 1) // BUCKET)
                    index, terms, docs, held = {}, [], [], 0
        if held:
            yield flush(part << 31 | (seen - 1) // BUCKET)

    return src.mapInArrow(run, "term string, bucket bigint, container binary, occurrences bigint")


@F.pandas_udf(T.BinaryType())
def _union_udf(lists: pd.Series) -> pd.Series:
    return lists.map(lambda x: union([bytes(c) for c in x]))


@F.pandas_udf(T.LongType())
def _cardinality_udf(data: pd.Series) -> pd.Series:
    return data.map(lambda c: cardinality(bytes(c)))


def term_bitmaps(df: DataFrame, id_col: str, text_col: str, order_col: str | None = None) -> DataFrame:
    """Bitmaps merged by union: term, bucket, container, records, occurrences.

    Of rows that share an id the latest by ``order_col`` counts, ties by the
    greatest text.  A term's rows meet in one partition, at most one for each
    map task and bucket, so a term of every record makes no heavier group.
    """
    best = F.max(F.struct(*([F.col(order_col)] if order_col else []), F.col(text_col).alias("_text"))).alias("_best")
    records = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_rec")).agg(best).select("_rec", F.col("_best._text").alias("_text"))
    merged = (
        term_containers(records, "_rec", "_text")
        .repartition("term")
        .groupBy("term", "bucket")
        .agg(F.collect_list("container").alias("parts"), F.sum("occurrences").alias("occurrences"))
        .withColumn("container", F.when(F.size("parts") == 1, F.col("parts")[0]).otherwise(_union_udf("parts")))
    )
    records_of = F.when(F.octet_length("container") % 2 == 0, (F.octet_length("container") / 2).cast("bigint")).otherwise(_cardinality_udf("container"))
    return merged.select("term", "bucket", "container", records_of.alias("records"), "occurrences")


def term_frequencies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order_col: str | None = None, rare_most: int = 2, common_share: float = 0.2) -> DataFrame:
    """term, occurrences, df, corpus_docs, mark of every distinct term over the distinct ids.

    ``mark`` is ``rare`` (in at most ``rare_most`` records), ``common`` (in
    more than ``common_share`` of all records) or null.  Records without text
    count among all; rows without an id are no records.  An empty table gives
    no row.
    """
    total = df.agg(F.count_distinct(F.col(id_col)).alias("n")).scalar()
    counted = term_bitmaps(df, id_col, text_col, order_col).groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("df"))
    mark = F.when(F.col("df") <= rare_most, "rare").when(F.col("df") > F.lit(common_share) * F.col("corpus_docs"), "common")
    return counted.withColumn("corpus_docs", total).withColumn("mark", mark)
