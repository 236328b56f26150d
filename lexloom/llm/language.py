"""Problem 4: language of documents and lines by prediction by partial matching (PPM).

A model is a set of per-language context trees over bytes (orders 0 to
``ORDER``) with frozen counts.  The code length of a byte in a language is
that of its longest known context, after the escapes from longer contexts
where the byte was not seen.  As counts are frozen, lengths depend on the last
``ORDER`` bytes only, so a batch is scored by looking up each distinct
context once, in all languages together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.langdata import LANGUAGES, label_language, plain, training_lines

ORDER = 5  # bytes of context; a context and its byte fit into one 64-bit key
PAD = b"\n" * ORDER


def _keys(data: np.ndarray, size: int) -> np.ndarray:
    """The last ``size`` bytes up to each position from ORDER on, packed into an integer."""
    out = np.zeros(len(data) - ORDER, np.uint64)
    for k in range(size):
        out |= data[ORDER - k : len(data) - k].astype(np.uint64) << np.uint64(8 * k)
    return out


def _stream(lines: list[bytes]) -> np.ndarray:
    return np.frombuffer(PAD + b"".join(x + PAD for x in lines), np.uint8)


class PPM:
    """Frozen context trees of all languages, merged: per order the known (context, byte) pairs and contexts with their costs in bits."""

    def __init__(self, lines: dict[str, list[str]]):
        self.langs = tuple(lines)
        n_langs = len(self.langs)
        counts = []  # per language and order: keys, counts
        for lang in self.langs:
            data = _stream([b for x in lines[lang] if (b := plain(x).encode())])
            inner = np.ones(len(data) - ORDER, bool)
            inner[data[ORDER:] == 10] = False  # the padding is context, not text
            counts.append([np.unique(_keys(data, k + 1)[inner], return_counts=True) for k in range(ORDER + 1)])
        self.pairs, self.pair_bits, self.contexts, self.escape_bits = [], [], [], []
        for k in range(ORDER + 1):
            pairs = np.unique(np.concatenate([counts[i][k][0] for i in range(n_langs)]))
            contexts = np.unique(pairs >> np.uint64(8))
            bits = np.full((len(pairs), n_langs), np.inf, np.float32)
            escape = np.zeros((len(contexts), n_langs), np.float32)
            for i in range(n_langs):
                key, c = counts[i][k]
                own, at = np.unique(key >> np.uint64(8), return_inverse=True)
                total, distinct = np.bincount(at, c), np.bincount(at)
                bits[np.searchsorted(pairs, key), i] = -np.log2(c / (total + distinct)[at])
                escape[np.searchsorted(contexts, own), i] = -np.log2(distinct / (total + distinct))
            self.pairs.append(pairs)
            self.pair_bits.append(bits)
            self.contexts.append(contexts)
            self.escape_bits.append(escape)

    def _costs(self, key: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each distinct key (ORDER context bytes and the byte), for all languages."""
        total = np.zeros((len(key), len(self.langs)), np.float32)
        still = np.ones(total.shape, bool)
        for k in range(ORDER, -1, -1):
            mask = np.uint64((1 << 8 * (k + 1)) - 1)
            part = key & mask
            at = np.minimum(np.searchsorted(self.pairs[k], part), len(self.pairs[k]) - 1)
            known = self.pairs[k][at] == part
            bits = np.where(known[:, None], self.pair_bits[k][at], np.inf)
            seen = np.isfinite(bits)
            now = still & seen
            total[now] += bits[now]
            context = part >> np.uint64(8)
            at = np.minimum(np.searchsorted(self.contexts[k], context), len(self.contexts[k]) - 1)
            there = (self.contexts[k][at] == context)[:, None] & still & ~seen
            total += np.where(there, self.escape_bits[k][at], 0)
            still &= ~seen
            if not still.any():
                break
        return total + 8.0 * still

    def score(self, lines: list[str], most: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
        """Code length in bits of each line in each language, and bytes per line."""
        out = np.zeros((len(lines), len(self.langs)), np.float32)
        data = [x.encode("utf-8", "replace") for x in lines]
        size = np.fromiter(map(len, data), np.int64, len(data))
        begin = 0
        while begin < len(data):
            end, held = begin, 0
            while end < len(data) and (end == begin or held + size[end] <= most):
                held += size[end] + ORDER
                end += 1
            self._score_part(data[begin:end], out[begin:end])
            begin = end
        return out, size

    def _score_part(self, data: list[bytes], out: np.ndarray, piece: int = 1 << 20) -> None:
        stream = _stream(data)
        line = np.repeat(np.arange(len(data)), np.fromiter((len(x) + ORDER for x in data), np.int64, len(data)))
        for at in range(0, len(line), piece):  # a line longer than a piece is summed up over several
            cut = stream[at : at + piece + ORDER]
            owner = line[at : at + piece]
            real = cut[ORDER:] != 10
            keys, where = np.unique(_keys(cut, ORDER + 1)[real], return_inverse=True)
            if len(keys):
                costs, owner = self._costs(keys), owner[real]
                first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                out[owner[first]] += np.add.reduceat(costs[where], first, axis=0)


def fit_ppm(corpus: DataFrame, **bounds) -> PPM:
    """Model from a bounded sample of labelled rows; see :func:`lexloom.llm.langdata.training_lines` for the bounds."""
    return PPM(training_lines(corpus, **bounds))


_STOP = re.compile(r"[.,!?;。，、！？；]")


def odd_word(line: str) -> bool:
    """Whether a line is a single short word or code and no sentence; such a line says nothing about the languages of its text."""
    return len(line) <= 16 and len(line.split()) == 1 and not _STOP.search(line)


def judge_lines(model: PPM, lines: list[str], junk_bits: float = 6.4) -> list[tuple[str, float, np.ndarray, int]]:
    """(language, confidence, bits by language, letters) of each line on its own; ``und`` where nothing is in a natural language."""
    texts = [plain(x) for x in lines]
    bits, size = model.score(texts)
    out = []
    for line, text, b, n in zip(lines, texts, bits, size):
        letters = sum(map(str.isalpha, text))
        words = text.count(" ") + 1
        if letters < 2 or (letters <= 24 and len(line.split()) - words >= 2 * words):  # nothing, or next to nothing, beside codes
            out.append(("und", 1.0, b, letters))
            continue
        best = int(b.argmin())
        if letters >= 8 and b[best] / n > junk_bits:  # longer than text of any language, even of unknown words
            out.append(("und", 1.0, b, letters))
            continue
        odds = np.exp2(np.clip(b[best] - b, -60, 0))
        out.append((model.langs[best], float(odds[best] / odds.sum()), b, letters))
    return out


def judge_text(model: PPM, judged: list[tuple[str, float, np.ndarray, int]], odd: list[bool], sure_bits: float = 14.0) -> tuple[str, float, list[tuple[str, float]], bool]:
    """Main language with confidence, each line's language given the main one, and whether the lines are in more than one.

    The main language is that of most letters.  A line counts as another
    language only where that one codes it ``sure_bits`` shorter than the main
    language, so names and odd words don't make a text mixed; lines that are
    ``odd`` words count only where there is nothing else.
    """
    weight: dict[str, float] = {}
    for full in (False, True):
        for (lang, _, _, letters), o in zip(judged, odd):
            if lang != "und" and (full or not o):
                weight[lang] = weight.get(lang, 0) + letters
        if weight:
            break
    if not weight:
        return "und", 1.0, [("und", 1.0)] * len(judged), False
    main = max(weight, key=lambda x: (weight[x], x))
    k = model.langs.index(main)
    lines, sure, seen = [], 0.0, set()
    for (lang, conf, bits, letters), o in zip(judged, odd):
        if lang not in ("und", main) and bits[k] - bits.min() < sure_bits:
            lang, conf = main, 1 - conf
        lines.append((lang, conf))
        if lang != "und" and not o:
            seen.add(lang)
            sure += conf * letters * (lang == main)
    return main, min(1.0, sure / sum(weight.values())) if seen else 1.0, lines, len(seen) > 1


def detect_languages(corpus: DataFrame, model: PPM, id_col: str = "doc_id", text_col: str = "text", title_col: str = "title", label_col: str = "lang_label", order_col: str = "ingested_at") -> DataFrame:
    """``(doc_id, line_no, lang, confidence)``.

    One row with ``line_no`` -1 and the main language for each record whose
    label is missing or names another language, and one row for each
    non-blank line of each record whose lines are in more than one language.
    Of rows that share an id the latest counts (ties by the greatest values);
    rows without an id are no records.  The title stands in where the text is
    null or blank; where nothing is in a natural language the answer is
    ``und``.
    """
    spark = corpus.sparkSession
    shared = spark.sparkContext.broadcast(model)
    best = F.max(F.struct(F.col(order_col).alias("o"), F.col(text_col).alias("text"), F.col(title_col).alias("title"), label_language(F.col(label_col)).alias("label"))).alias("_best")
    records = corpus.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(best).select("_id", "_best.text", "_best.title", "_best.label")
    kind = records.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ppm = shared.value
        for batch in batches:
            _, texts, titles, labels = (c.to_pylist() for c in batch.columns)
            lines, span = [], []  # all non-blank lines of the batch, and each record's share of them
            for text, title in zip(texts, titles):
                titled = not (text and text.strip())
                own = [(i, x) for i, x in enumerate(((title or "") if titled else text).split("\n")) if x.strip()]
                span.append((len(lines), len(own), titled))
                lines.extend(own)
            judged = judge_lines(ppm, [x for _, x in lines])
            rows, out = [], {"line_no": [], "lang": [], "confidence": []}

            def put(row: int, no: int, lang: str, conf: float) -> None:
                rows.append(row)
                for c, v in zip(out, (no, lang, conf)):
                    out[c].append(v)

            for r, (at, n, titled) in enumerate(span):
                main, conf, by_line, is_mixed = judge_text(ppm, judged[at : at + n], [odd_word(x.strip()) for _, x in lines[at : at + n]])
                if labels[r] != main:
                    put(r, -1, main, conf)
                if is_mixed and not titled:
                    for (no, _), (lang, c) in zip(lines[at : at + n], by_line):
                        put(r, no, lang, c)
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(out["line_no"], pa.int32()), pa.array(out["lang"]), pa.array(out["confidence"], pa.float64())], names=[id_col, *out])

    return records.mapInArrow(run, f"`{id_col}` {kind}, line_no int, lang string, confidence double")
