"""Problem 7: passages of held-out items found in a corpus by template windows and slot consistency.

Texts are canonicalised into templates: compatibility forms, case, look-alike
letters, spacing and punctuation are levelled, numbers (with their units) and
names become typed placeholders.  Windows over the template are hash-joined
with those of the items; the matches of a document and an item are chained
along their diagonals, slots must agree consistently, and the item's share
that the chains cover decides.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 20  # units of a window: a Hangul, Han or kana character counts as two units, any other letter as one
NUMBER, UNIT, NAME = "\ue000", "\ue001", "\ue002"  # placeholders, from the private use area
# Units that may follow a number, nouns of bodies whose names precede them in Korean, and Cyrillic and Greek letters that look like Latin ones.
_UNITS = "percent|per cent|standard units|units?|days?|weeks?|months?|years?|hours?|minutes?|cases|plots|samples|rows|gigabytes|퍼센트|개월|단위|시간|구역|주|일|년|분|개|건"
_BODIES = "연구회|연구소|연구진|연구팀|연구원|실험실|관측소|조사단|코호트|컨소시엄|대학교?|학회|협회|재단|병원|센터"
_LOOKALIKE = str.maketrans("аеорсухіѕјкмтнвгԁӏοανρτικυ", "aeopcyxisjkmthbrdloavptiku")
_SLOT = re.compile(rf"(?P<number>\d+(?:[.,]\d+)*)(?P<gap>[ -]?)(?P<unit>{_UNITS})?|(?<![가-힣])(?P<korean>[가-힣]{{2,5}})(?= (?:{_BODIES}))|(?<=[a-z,;] )(?P<name>[A-Z][a-z]{{3,}}(?:[A-Z][a-z]+)*)")
_BREAK = re.compile("(?<=[^\\W\\d_])-[ \\t]*\\r?\\n[ \\t]*(?=[^\\W\\d_])|[\\u00ad\\u200b-\\u200f\\u2060\\ufeff\\ue000-\\ue002]")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>|<!--.*?-->", re.S)
_KEEP: np.ndarray | None = None
_WIDE: np.ndarray | None = None
_LEVEL: np.ndarray | None = None


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which codepoints are kept (letters, placeholders), which count as two units, and what look-alikes stand for; built once per process."""
    global _KEEP, _WIDE, _LEVEL
    if _KEEP is None:
        _KEEP = np.fromiter((unicodedata.category(chr(i))[0] in "LN" for i in range(0x110000)), bool, 0x110000)
        _KEEP[[ord(NUMBER), ord(UNIT), ord(NAME)]] = True
        _WIDE = np.zeros(0x110000, bool)
        for a, b in ((0x3040, 0x3100), (0x3400, 0xA000), (0xAC00, 0xD7A4), (0xF900, 0xFB00), (0x20000, 0x32000)):
            _WIDE[a:b] = True
        _LEVEL = np.arange(0x110000, dtype=np.uint32)
        _LEVEL[list(_LOOKALIKE)] = list(_LOOKALIKE.values())
    return _KEEP, _WIDE, _LEVEL


def template(text: str, values: list[int]) -> str:
    """The text with numbers, their units and names as placeholders, and markup and case levelled; spacing and look-alike letters stay.

    Hashes of the replaced wordings are appended to ``values``; their two
    lowest bits say which kind of slot they fill (1 number, 2 unit, 3 name).
    """

    def fill(wording: str, kind: int) -> None:
        values.append(zlib.crc32(wording.casefold().encode("utf-8", "replace")) & 0x7FFFFFFC | kind)

    def placeholder(m: re.Match) -> str:
        if m["number"]:
            fill(m["number"], 1)
            if not m["unit"]:
                return NUMBER + m["gap"]
            fill(m["unit"], 2)
            return NUMBER + UNIT
        fill(m[0], 3)
        return NAME

    if "<" in text:
        text = _TAG.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    return _SLOT.sub(placeholder, unicodedata.normalize("NFKC", _BREAK.sub("", text))).casefold()


def template_windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows over all texts: hash, text index, position in units, slot values of the first and last unit (upper and lower half); and units per text last."""
    values: list[int] = []
    joined = [template(t, values) for t in texts]
    lengths = np.fromiter(map(len, joined), np.int64, len(joined))
    points = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32)
    keep, wide, plain = _tables()
    points = plain[points]
    kept = keep[points]
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)[kept]
    points = points[kept]
    twice = 1 + wide[points].astype(np.int64)
    units, doc = np.repeat(points, twice).astype(np.uint64), np.repeat(doc, twice)
    size = np.bincount(doc, minlength=len(texts))
    n = len(units) - WINDOW + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none, size
    base = 0x9E3779B97F4A7C15
    power = lambda k: np.uint64(pow(base, k, 1 << 64))
    h = (units + np.uint64(7)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    by = {1: h}
    for k in (1, 2, 4, 8):  # hashes of windows of 2, 4, 8, 16 units, each from two halves
        by[2 * k] = by[k][:-k] * power(k) + by[k][k:]
    full = by[16][: n + 4][:n] * power(4) + by[4][16 : 16 + n]
    full ^= full >> np.uint64(31)
    valid = doc[:n] == doc[WINDOW - 1 :]
    first = np.concatenate([[0], np.cumsum(size)])[:-1]
    at = np.flatnonzero(valid)
    held = np.zeros(len(units), np.int64)
    held[(units >= ord(NUMBER)) & (units <= ord(NAME))] = values
    return full[at], doc[at], at - first[doc[at]], held[at] << 32 | held[at + WINDOW - 1], size


def _windows_df(df: DataFrame, id_col: str, text_col: str, id_name: str, wanted=None, batch_chars: int = 1_000_000) -> DataFrame:
    """hash, id, pos, slots, units of every window; of those that ``wanted`` lets through, where given (a broadcast sorted array of hashes, or packed bits by hash prefix)."""
    src = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_through = _hash_filter(wanted.value) if wanted is not None else None
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            i = 0
            while i < len(texts):
                j, held = i, 0
                while j < len(texts) and (j == i or held + len(texts[j]) <= batch_chars):
                    held += len(texts[j])
                    j += 1
                h, doc, pos, slots, size = template_windows(texts[i:j])
                if let_through is not None:
                    hit = let_through(h)
                    h, doc, pos, slots = h[hit], doc[hit], pos[hit], slots[hit]
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), ids.take(pa.array(doc + i)), pa.array(pos.astype(np.int32)), pa.array(slots), pa.array(size[doc].astype(np.int32))], names=["hash", id_name, "pos", "slots", "units"])
                i = j

    return src.mapInArrow(run, f"hash bigint, `{id_name}` {kind}, pos int, slots bigint, units int")


def _hash_filter(wanted: np.ndarray):
    """Function from hashes to the positions of those that may be wanted (prefix bits) or are (sorted hashes)."""
    if wanted.dtype == np.uint8:
        shift = np.uint64(64 - (len(wanted) * 8 - 1).bit_length())
        return lambda h: np.flatnonzero(wanted[(at := h >> shift) >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8) & 1)
    if not len(wanted):
        return lambda h: np.zeros(0, np.int64)
    probe = np.zeros(1 << 24, bool)  # a bit per hash prefix sorts out nearly all windows before the exact look-up
    probe[wanted >> np.uint64(40)] = True

    def exact(h: np.ndarray) -> np.ndarray:
        hit = np.flatnonzero(probe[h >> np.uint64(40)])
        return hit[wanted[np.minimum(np.searchsorted(wanted, h[hit]), len(wanted) - 1)] == h[hit]]

    return exact


Run = tuple[int, int, int]  # start and end in the item's units, diagonal (position in the document less that in the item)


def chained_runs(item_pos: np.ndarray, doc_pos: np.ndarray, gap: int = 30, shift: int = 24, least: int = 36, density: float = 0.8) -> list[list[Run]]:
    """Stretches of the item that the document holds, each as its runs of matches on one diagonal.

    Runs are joined where the gap in the item is at most ``gap`` units and the
    diagonals differ by at most ``shift`` (a word put in, left out or
    changed); a stretch counts with ``least`` matched units that make up
    ``density`` of it, so scattered shared phrases don't.
    """
    order = np.lexsort((item_pos, doc_pos - item_pos))
    i, d = item_pos[order], (doc_pos - item_pos)[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(d) != 0) | (np.diff(i) > WINDOW)]))
    last = np.append(new[1:], len(i)) - 1
    runs = sorted(zip(i[new].tolist(), (i[last] + WINDOW).tolist(), d[new].tolist()), key=lambda r: (r[0] + r[2], r[0]))
    done, growing, crowded = [], [], 64  # chains: their end, units matched, last diagonal, runs
    for a, b, diag in runs:  # in the order of the document
        best = None
        for c in growing:
            if -WINDOW <= a - c[0] <= gap and abs(diag - c[2]) <= shift and b > c[0] and (best is None or c[0] > best[0]):
                best = c
        if best is None:
            growing.append([b, b - a, diag, [(a, b, diag)]])
        else:
            best[1] += b - max(a, best[0])
            best[0], best[2] = b, diag
            best[3].append((a, b, diag))
        if len(growing) >= crowded:  # those that no later run can reach any more are done
            reach = a + diag - gap - shift
            done.extend(c for c in growing if c[0] + c[2] < reach)
            growing = [c for c in growing if c[0] + c[2] >= reach]
            crowded = max(64, 2 * len(growing))
    done.extend(growing)
    return [r for end, matched, _, r in done if matched >= least and matched >= density * (end - r[0][0])]


def chains(item_pos: np.ndarray, doc_pos: np.ndarray, **bounds) -> list[tuple[int, int]]:
    """The same stretches as (start, end) in the item's units; see :func:`chained_runs`."""
    return [(runs[0][0], runs[-1][1]) for runs in chained_runs(item_pos, doc_pos, **bounds)]


def covered(stretches: list[tuple[int, int]]) -> int:
    """Units in the union of stretches."""
    total, reach = 0, -1
    for a, b in sorted(stretches):
        if b > reach:
            total += b - max(a, reach)
            reach = b
    return total


def aligned_slots(stretches: list[list[Run]], item_pos: np.ndarray, doc_pos: np.ndarray, item_slots: np.ndarray, doc_slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fillings of the item's slots and what the document has in their place, along the stretches.

    A slot is read off the windows that begin or end with it, and counts once
    however many windows hold it.  Where several places of the document stand
    for a slot, one that fills it alike speaks for it; without one, each of
    the different fillings counts.
    """
    kept = np.zeros(len(item_pos), bool)
    for runs in stretches:
        for a, b, diag in runs:
            kept |= (doc_pos - item_pos == diag) & (item_pos >= a) & (item_pos + WINDOW <= b)
    at, a, b = item_pos[kept], item_slots[kept], doc_slots[kept]
    at, a, b = np.concatenate([at, at + WINDOW - 1]), np.concatenate([a >> 32, a & 0xFFFFFFFF]), np.concatenate([b >> 32, b & 0xFFFFFFFF])
    at, a, b = np.unique(np.stack([at, a, b])[:, a > 0], axis=1)
    alike = a == b
    kept = alike | ~np.isin(at, at[alike])
    return a[kept], b[kept]


def slots_agree(item_slots: np.ndarray, doc_slots: np.ndarray, least: int = 3) -> bool:
    """Whether the document fills the item's slots consistently, judged for each kind of slot.

    Slots filled alike agree.  Where a filling was exchanged, those slots tell
    whose filling comes again, in the item or in the document: they agree if
    the two fillings are each other's most frequent counterpart.  So a filling
    exchanged throughout agrees, one filled now so and now so doesn't, and
    neither do different fillings that all became one.  Of a kind with
    ``least`` telling slots, more than half must agree.
    """
    filled = item_slots != 0
    pairs: dict[int, Counter] = {}
    for a, b in zip(item_slots[filled].tolist(), doc_slots[filled].tolist()):
        pairs.setdefault(a & 3, Counter())[a, b] += 1
    for counts in pairs.values():
        there: dict[int, Counter] = {}
        back: dict[int, Counter] = {}
        for (a, b), n in sorted(counts.items()):
            there.setdefault(a, Counter())[b] += n
            back.setdefault(b, Counter())[a] += n
        agree = total = 0
        for (a, b), n in counts.items():
            if a == b or there[a].total() > 1 or back[b].total() > 1:
                total += n
                agree += n * (a == b or (there[a].most_common(1)[0][0] == b and back[b].most_common(1)[0][0] == a))
        if total >= least and agree * 2 <= total:
            return False
    return True


def held_share(item_pos: np.ndarray, doc_pos: np.ndarray, item_slots: np.ndarray, doc_slots: np.ndarray, units: int, exchanged: float = 0.75) -> float:
    """Share of an item's units that a document holds, from the matches of their windows.

    It is 0 where slots are filled inconsistently.  Where the item has two
    numbers or names in what is held and the document fills none alike,
    the template is only a way of phrasing, unless at least ``exchanged`` of
    the item is there: then it is the same question with other parameters.
    """
    stretches = chained_runs(item_pos, doc_pos)
    share = covered([(runs[0][0], runs[-1][1]) for runs in stretches]) / max(1, units)
    if not share:
        return 0.0
    a, b = aligned_slots(stretches, item_pos, doc_pos, item_slots, doc_slots)
    told = (a & 3) != 2  # numbers and names; units belong to the phrasing
    if not slots_agree(a, b) or (share < exchanged and told.sum() > 1 and not (a == b)[told].any()):
        return 0.0
    return share


@F.pandas_udf(T.DoubleType())
def _share_udf(matches: pd.Series, units: pd.Series) -> pd.Series:
    def share(rows, n: int) -> float:
        return held_share(*(np.fromiter((r[k] for r in rows), np.int64, len(rows)) for k in ("i", "d", "a", "b")), n)

    return pd.Series([share(m, n) for m, n in zip(matches, units)], dtype="float64")


def notice_spans(positions: np.ndarray, least: int = 40) -> list[dict]:
    """Stretches of an item that are notices: at least ``least`` consecutive windows, all of them shared with other items."""
    p = np.unique(positions)
    if not len(p):
        return []
    new = np.flatnonzero(np.concatenate([[True], np.diff(p) > 1]))
    last = np.append(new[1:], len(p)) - 1
    return [{"a": int(p[i]), "b": int(p[j]) + WINDOW} for i, j in zip(new, last) if j - i + 1 >= least]


@F.udf(T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])), useArrow=True)
def _notice_udf(positions: list[int]) -> list[dict]:
    return notice_spans(np.asarray(positions))


def item_windows(items: DataFrame, id_col: str, text_col: str, phrase_share: float = 0.025, phrase_least: int = 8, notice_items: int = 3) -> DataFrame:
    """Distinctive windows of the items: hash, item_id, item_pos, item_slots, item_units.

    Left out are windows of phrasing, which more than ``phrase_share`` of the
    different items have (and more than ``phrase_least``), and those inside a
    notice, a long stretch that ``notice_items`` or more different items share
    word for word; ``item_units`` is the item's length without notices.
    Copies of an item count once.  An item that would lose more than four
    fifths of itself to either (one of a family of near copies) keeps all of
    its windows.
    """
    windows = _windows_df(items, id_col, text_col, "item_id").withColumnsRenamed({"pos": "item_pos", "slots": "item_slots", "units": "item_units"})
    copies = items.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("item_id"), F.xxhash64(text_col).alias("_text"))
    different = copies.agg(F.count_distinct("_text")).scalar()
    counted = windows.select("hash", "item_id").join(copies, "item_id").groupBy("hash").agg(F.count_distinct("_text").alias("_n")).where(F.col("_n") >= notice_items)
    marked = windows.join(counted, "hash", "left").withColumn("_phrase", F.coalesce(F.col("_n") > F.greatest(F.lit(phrase_least), F.lit(phrase_share) * different), F.lit(False)))
    shared = F.collect_set(F.when(F.col("_n").isNotNull(), F.col("item_pos")))
    spans = marked.groupBy("item_id").agg(_notice_udf(shared).alias("_s"), (F.count_if("_phrase") > F.count("*") * 0.8).alias("_common"))
    length = F.aggregate("_s", F.lit(0), lambda t, s: t + s["b"] - s["a"])
    own = marked.join(spans, "item_id").withColumn("_whole", F.col("_common") | (length > F.col("item_units") * 0.8))
    inside = F.exists("_s", lambda s: (F.col("item_pos") >= s["a"]) & (F.col("item_pos") + WINDOW <= s["b"]))
    kept = own.where(F.col("_whole") | ~(F.col("_phrase") | inside))
    return kept.select("hash", "item_id", "item_pos", "item_slots", F.when(F.col("_whole"), F.col("item_units")).otherwise(F.col("item_units") - length).alias("item_units"))


def _prefix_filter(windows: DataFrame, bits: int) -> np.ndarray:
    """A bit for each of the ``2 ** bits`` hash prefixes that occur; the prefixes are gathered in blocks of at most 2 ** 16 by Spark."""
    prefix = F.shiftrightunsigned("hash", 64 - bits)
    blocks = windows.select(F.shiftright(prefix, 16).alias("block"), prefix.bitwiseAND(F.lit(0xFFFF)).cast("int").alias("bit")).groupBy("block").agg(F.collect_set("bit").alias("bits"))
    there = np.zeros(1 << bits, bool)
    for block, set_bits in blocks.toLocalIterator():
        there[(block << 16) + np.asarray(set_bits, np.int64)] = True
    return np.packbits(there)


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "item_text", share: float = 0.37, broadcast_most: int = 300_000, filter_bits: int = 26, salt: int = 16) -> DataFrame:
    """``(doc_id, item_id, share)``: documents that hold at least ``share`` of an item's wording without its notices, in one or several places.

    Null texts, and texts of fewer than 20 units, hold nothing.  Item ids are
    taken as distinct; a repeated document row gives its pairs once.

    The items' windows are made once.  Up to ``broadcast_most`` of them go to
    the executors whole, for an exact look-up in the scan and a broadcast
    join.  Beyond that the scan is filtered by hash prefixes (``2 **
    filter_bits`` bits, whatever the number of items), and documents and items
    are joined by a shuffle on the hash and a salt by document, so a window
    that very many documents hold is spread over ``salt`` partitions.
    """
    spark = docs.sparkSession
    windows = item_windows(items, item_id, item_text).persist()
    few = windows.limit(broadcast_most + 1).toArrow() if broadcast_most else None
    if few is not None and few.num_rows <= broadcast_most:
        windows.unpersist()
        windows, keys = F.broadcast(spark.createDataFrame(few, windows.schema)), ["hash"]
        wanted = np.unique(few.column("hash").to_numpy().view(np.uint64))
    else:
        wanted, keys = _prefix_filter(windows, filter_bits), ["hash", "_salt"]
        windows = windows.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    found = _windows_df(docs, doc_id, text_col, "doc_id", spark.sparkContext.broadcast(wanted)).select("hash", "doc_id", F.col("pos").alias("d"), F.col("slots").alias("b"))
    if "_salt" in keys:
        found = found.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(salt)).cast("int"))
    match = F.struct(F.col("item_pos").alias("i"), "d", F.col("item_slots").alias("a"), "b")
    pairs = found.join(windows, keys).groupBy("doc_id", "item_id").agg(F.collect_set(match).alias("m"), F.max("item_units").alias("n"))
    near = pairs.where(F.size("m") * WINDOW >= F.col("n") * share * 0.8)  # a match covers a window, and at least 0.8 of a stretch is matched
    return near.select("doc_id", "item_id", _share_udf("m", "n").alias("share")).where(F.col("share") >= share)
