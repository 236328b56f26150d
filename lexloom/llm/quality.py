"""Problem 8: per-document quality statistics, and natural prose told from lists, tables and junk.

A line is a distribution over classes of words and characters: function words
of its language, other words, words that come again, numbers, codes, entry
marks, symbols, lost and garbled characters, sentence stops, commas, cell
separators, signs of relation and the line end.  The same distributions are
measured over prose of each language and over the forms of lists, tables and
junk (:mod:`lexloom.llm.structures`).  A line's Jensen-Shannon divergence to a
structure is that to its nearest profile, and a document is of the structure
to which its lines, weighted by length, are nearest in the mean.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.seeds import SEED
from lexloom.llm.structures import STRUCTURES, structural_samples
from lexloom.llm.wording import CJK, EDGES, HANGUL, NUMBER, east_asian, token_class

CLASSES = ("function", "word", "again", "number", "code", "mark", "symbol", "lost", "garbled", "stop", "comma", "separator", "relation", "end")
FUNCTION, WORD, AGAIN, NUMERIC, CODE, MARK, SYMBOL, LOST, GARBLED, STOP, COMMA, SEPARATOR, RELATION, END = range(len(CLASSES))
LINE_END = 1.5  # units of a line end beside one unit a word
LINE_CHARS = 8  # what a line weighs beside its characters

_ENDS, _CLOSERS = (".", "!", "?", "。", "！", "？", "…", ":", ";"), "\"'”’)]」』"
_LINES = re.compile(r"[\r\n\x0b\x0c\x85\u2028\u2029]+")
_INNER_BREAK = re.compile(r"[\x1c-\x1e]")  # splitlines alone takes them for line ends
_RULER = re.compile(r"^[\s|+\-=:─━┼┬┴├┤│┌┐└┘═╪╬]+$")
_ENTRY = re.compile(r"^(?:(?:[-*•▶·‣◦○●■□◆▪–—]|\[[ xXvV]?\]|[☐☑☒✓✔]|\(?\d{1,3}[.)]|\[\d{1,3}\]|\(?[a-zA-Z가-힣][.)]|[①-⑳])\s+|\d+(?:\.\d+)+\.?\s(?=[^\W\d_]))")
_PATH = re.compile(r"^(?:[A-Za-z]:)?[/\\]\S+$|^\S+[/\\]\S+[/\\]\S*$|^https?://\S+$")
_INLINE_TAG = re.compile(r"</?(?!t[rdh][ >/]|table|thead|tbody)[a-zA-Z][^<>\n]{0,100}>")
_SEPARATOR = re.compile(r"[|│\t;,<\s](?:(?<=[|│\t])|(?<=;)(?!\s*$)|(?<=,)(?=\S)|(?<=\s)(?:(?<=\S\s)\s+(?=\S)|--(?=\s)|[/›»·•#](?=\s|\w))|(?<=<)/?t[rdh][ >/])")  # its first character is looked for alone
_PLAIN = re.compile(r"[0-9a-z.,:/%_'-]+")
_DIGIT = re.compile(r"[0-9]")
_LETTER = re.compile(r"[a-z]")
_EMPTY_CELL = re.compile(r"^\s{3,}\S|^\t+|\t(?=\t)")
_RELATION = re.compile(r"[=→⇒:.…–—-](?:(?<=[=→⇒])|(?<=-)>|(?<=:)(?=\s)|(?<=\s[-–—])(?=\s)|(?<=\.)\.{3,}|(?<=…)…+)")
_WIDE_RELATION = re.compile(r"[→⇒–—…]")
_JAMO = re.compile(r"[ㄱ-ㅣ]")
_LOST = re.compile(r"\?{2,}|�+|[ㄱ-ㅣ]+")
_STOP = re.compile(r"[.!?。！？](?=[\s\"'”’)\]」』]|$|[^\x00-\x7f])")
_COMMA = re.compile(r"[,，、](?=\s|$|[^\x00-\x7f])|;\s*$")
_THOUSAND = re.compile(r"(?<![\w.,])(\d{1,3}),(\d{3})(?![\w,]|\.\d)")
_COMMA_DIGITS = re.compile(r",\d{3}")
_WIDE_COMMA = re.compile(r"[，、]")
_BYTE = re.compile(r"^[0-9a-fA-F]{2}$")
_ODD = re.compile(r"(?<=\w)[{}|`^~§¬!;<>#&*=+$@](?=\w)|[{}`^~§¬|]{2}")
_STRAY = re.compile(r"[{}|`^~§¬!;'<>#&*=+$@]")
_INLINE_MARK = re.compile(r"\*\*|\[(?<=\w\[)\d{1,3}\]|&[a-z]{2,6};")
_ALNUM = re.compile(r"[^\W_]+")
_ASCII_ALNUM = bytes(c for c in range(128) if chr(c).isalnum())
_FULL_WIDTH = re.compile(r"[Ａ-ｚ]")
_PIECES = re.compile(r"(?<=[。！？])|\s+")
_LATIN = "abcdefghijklmnopqrstuvwxyz"
_LATIN_BYTES = [c.encode() for c in _LATIN]
#: Letter counts of running Latin text, from the seeds of the languages that are written so.
LETTERS = tuple(sum(SEED[lang].lower().count(c) for lang in ("en", "de", "fr", "es", "pt")) for c in _LATIN)


def divergence(p: tuple[float, ...], q: tuple[float, ...]) -> float:
    """Jensen-Shannon divergence in bits of two count or share vectors; 1 where one is empty."""
    a, b = sum(p), sum(q)
    if not a or not b:
        return 1.0
    total = 0.0
    for x, y in zip(p, q):
        x, y = x / a, y / b
        m = (x + y) / 2
        total += (x and x * math.log2(x / m)) + (y and y * math.log2(y / m))
    return total / 2


def _entropy(p: np.ndarray) -> np.ndarray:
    return -(p * np.log2(np.where(p > 0, p, 1.0))).sum(axis=-1)


def divergences(counts: np.ndarray, profiles: np.ndarray, step: int = 512) -> np.ndarray:
    """Jensen-Shannon divergence in bits of each row of counts to each profile.

    A class that a row lacks adds the same to each row's divergence from a
    profile; only those that it has take a logarithm a profile.  ``step`` rows
    at a time stay in the processor's cache.
    """
    half = profiles / 2
    lacking = half * np.log2(np.where(half > 0, half, 1.0))
    fixed = -lacking.sum(axis=1) - _entropy(profiles) / 2
    out = np.empty((len(counts), len(profiles)))
    for at in range(0, len(counts), step):
        p = counts[at : at + step]
        p = p / p.sum(axis=1, keepdims=True)
        d = out[at : at + step]
        d[:] = fixed - _entropy(p)[:, None] / 2
        for c in range(p.shape[1]):
            rows = np.flatnonzero(p[:, c])
            m = p[rows, c][:, None] / 2 + half[:, c]
            d[rows] -= m * np.log2(m) - lacking[:, c]
    return out


def letters_off(line: str) -> bool:
    """Whether a line's Latin letters are spread as in no language; the bound allows for chance in short lines."""
    low = line.lower()
    ascii_only, dense = low.encode("ascii", "ignore"), len(low) - low.count(" ")
    if (len(ascii_only) - ascii_only.count(b" ")) * 2 <= dense:
        return False
    counts = [ascii_only.count(c) for c in _LATIN_BYTES]
    n = sum(counts)
    return n >= 60 and n * 2 > dense and divergence(tuple(counts), LETTERS) > 0.05 + 5 / n


class _Unit:
    """What tokens of a kind count as: languages in which they are function words, class, units, and whether two hex digits.  Kept one of each, so that they are counted by identity."""

    __slots__ = ("langs", "kind", "units", "byte")

    def __init__(self, langs: str, kind: int, units: float, byte: bool):
        self.langs, self.kind, self.units, self.byte = tuple(langs.split()), kind, units, byte


_one_unit = lru_cache(maxsize=None)(_Unit)  # none is dropped, as a second one would count apart; there are no more than different lengths of tokens


class _Units(dict):
    """What each token counts as, kept for tokens of up to 64 characters, which recur; begun anew when full."""

    most = 1 << 18

    def __missing__(self, token: str) -> _Unit:
        unit = _one_unit(*_classed(token), len(token) == 2 and bool(_BYTE.match(token)))
        if len(token) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[token] = unit
        return unit


_UNITS = _Units()
_unit = _UNITS.__getitem__


def _classed(token: str) -> tuple[str, int, float]:
    """Languages in which a token is a function word, its class, and the units that it counts."""
    if len(token) == 1 and token.isupper() and token not in "AIO":
        return "", MARK, 1.0
    word = token.lower().strip(EDGES)
    symbols = "", SYMBOL, max(1.0, len(token) / 3)
    if not word:
        return ("", CODE, 1.0) if any(map(str.isalnum, token)) else symbols
    if len(word) < 40 and word.isalpha():  # letters alone are neither odd nor symbols
        return token_class(token)[0], WORD, 1.0
    if len(word) < 40 and _PLAIN.fullmatch(word) and (_DIGIT.search(word) or not _LETTER.search(word)):
        return "", CODE if _LETTER.search(word) else NUMERIC, 1.0
    korean = HANGUL.search(word)
    if len(word) >= 40 and not korean and not CJK.search(word) and not _PATH.match(token):
        return "", GARBLED, len(word) / 6
    if _ODD.search(word):
        return symbols
    if not korean:
        inner = sum(not c.isalnum() and c not in "-_'’./\\:,%" for c in token.strip(EDGES))
        if inner >= 2 and inner * 3 >= sum(map(str.isalnum, token)):
            return symbols
    langs, kind = token_class(token)
    if kind == 1:
        return langs, WORD, 1.0
    if kind == 2:
        return "", CODE if any(map(str.isalpha, word)) else NUMERIC, 1.0
    return symbols


def _apart(body: str) -> bool:
    """Whether a line with single spaces as its only white space may have separators; if not, each comma ends a word."""
    if "," in body and body.count(",") > body.count(", ") + body.endswith(","):
        return True
    if "|" in body or ";" in body or "<" in body or " #" in body or " /" in body or " --" in body:
        return True
    return not body.isascii() and ("│" in body or "·" in body or "•" in body or "›" in body or "»" in body)


def _come_again(tokens: list[str]) -> tuple[dict[_Unit, int], int]:
    """The tokens of a line that come again, by what they count as, and their number."""
    gone, n, seen, befores = {}, 0, set(), {}
    for at, token in enumerate(tokens):
        if token not in seen:
            seen.add(token)
            continue
        before, unit, known = tokens[at - 1], _unit(token), befores.get(token)
        if known is None:
            first = tokens.index(token)
            known = befores[token] = {tokens[first - 1] if first else ""}
        if before in known or (not unit.langs and unit.kind in (WORD, CODE)):
            gone[unit] = gone.get(unit, 0) + 1
            n += 1
        known.add(before)
    return gone, n


def line_counts(line: str, again: float = 0.0) -> tuple[list[float], int, int]:
    """Units of each class in a line, and its common words among all its words.

    ``again``: the share of repeated lines in the text where this line is a
    repeat, else 0; that share of its words counts as coming again.  Within a
    line a content word comes again with its second use, a function word where
    the word before it is the same too.
    """
    v = [0.0] * len(CLASSES)
    v[END] = LINE_END
    if _RULER.match(line):
        v[SEPARATOR] = 3.0
        return v, 0, 0
    body = line.strip()
    entry = _ENTRY.match(body)
    if entry:
        v[MARK] += 1
        body = body[entry.end() :]
    if "," in body and _COMMA_DIGITS.search(body):
        body = _THOUSAND.sub(r"\1\2", body)
    tokens, bare = body.split(), body
    even = " ".join(tokens) == body and not _apart(body)
    if not even:
        bare, v[SEPARATOR] = _SEPARATOR.subn(" ", body)
    if line[:1].isspace() or "\t\t" in line:
        v[SEPARATOR] += len(_EMPTY_CELL.findall(line))
    if "=" in bare or ":" in bare or " -" in bare or "->" in bare or "...." in bare or (not bare.isascii() and _WIDE_RELATION.search(bare)):  # otherwise there is nothing to find
        bare, v[RELATION] = _RELATION.subn(" ", bare)
    lang, ideographs, hits = east_asian(body)
    if lang:
        common, numbers = hits, len(NUMBER.findall(bare))
        words = ideographs + numbers
        v[FUNCTION], v[WORD], v[NUMERIC] = hits / 1.5, (ideographs - hits) / 2, numbers
        v[SYMBOL] = len(_STRAY.findall(body)) / 1.5
        pieces = [p for p in _PIECES.split(bare) if p]
        again = max(again, 1 - len(set(pieces)) / max(1, len(pieces)))
    else:
        if bare is not body:
            tokens = bare.split()
        units, by, pairs, gone = Counter(map(_unit, tokens)), {}, 0, {}
        if len(set(tokens)) < len(tokens):
            gone, v[AGAIN] = _come_again(tokens)
        for unit, n in units.items():
            if unit.byte:
                pairs += n
            if gone:
                n -= gone.get(unit, 0)
            v[unit.kind] += n * unit.units
            for x in unit.langs:
                by[x] = by.get(x, 0) + n
        common = max(by.values()) if by else 0
        words = int(v[WORD] + v[AGAIN] + v[NUMERIC] + v[CODE])
        v[FUNCTION] = common
        v[WORD] -= common
        if len(body) >= 60 and common < 0.12 * (v[WORD] + v[AGAIN] + common) and letters_off(body):
            v[GARBLED] += v[WORD]
            v[WORD] = 0.0
        if pairs >= 8:
            v[GARBLED] += pairs
            v[NUMERIC] = v[CODE] = 0.0
    if "??" in body or "�" in body or (not body.isascii() and _JAMO.search(body)):
        v[LOST] = sum(map(len, _LOST.findall(body))) / 2
    v[STOP] = len(_STOP.findall(body))
    v[COMMA] = body.count(",") if even and (body.isascii() or not _WIDE_COMMA.search(body)) else len(_COMMA.findall(body))
    if again:
        for kind in (WORD, FUNCTION):
            v[AGAIN] += v[kind] * again
            v[kind] *= 1 - again
    return v, common, words


@lru_cache(maxsize=1 << 16)
def _short_line(line: str) -> tuple[list[float], int, int]:
    return line_counts(line)


class Profiles:
    """Measured distributions of the forms of each structure."""

    def __init__(self, seed: int = 5, per_form: int = 60, floor: float = 0.005):
        samples = structural_samples(seed, per_form)
        self.forms = tuple(samples)
        rows = []
        for (structure, _, form), lines in samples.items():
            repeated = 0.95 if structure == "junk" and form.startswith("one ") else 0.0
            counts = np.array([line_counts(x, repeated)[0] for x in lines])
            rows.append((counts / counts.sum(axis=1, keepdims=True)).mean(axis=0))
        self.table = np.array(rows) * (1 - floor) + floor / len(CLASSES)  # no class is impossible
        self.of = tuple(np.array([i for i, f in enumerate(self.forms) if f[0] == s]) for s in STRUCTURES)

    def nearest(self, counts: np.ndarray) -> np.ndarray:
        """Divergence of each row of counts to the nearest profile of each structure."""
        if not len(counts):
            return np.zeros((0, len(STRUCTURES)))
        rounded, first = np.ascontiguousarray(np.round(counts, 3)), {}
        where = [first.setdefault(row, len(first)) for row in rounded.view(f"V{rounded.itemsize * rounded.shape[1]}").ravel().tolist()]
        distinct = np.frombuffer(b"".join(first), rounded.dtype).reshape(len(first), -1)
        d = divergences(distinct, self.table)
        return np.stack([d[:, of].min(axis=1) for of in self.of], axis=1)[where]


@lru_cache(maxsize=1)
def default_profiles() -> Profiles:
    return Profiles()


def _none() -> dict:
    return {"n_words": 0, "mean_word_len": None, "symbol_share": None, "punct_line_share": None, "common_share": None, "divergence": None, "kind": None}


@lru_cache(maxsize=1)
def _alphanumeric() -> np.ndarray:
    """Whether each code point of the first plane is a letter or digit."""
    table = np.zeros(1 << 16, bool)
    for run in _ALNUM.finditer("".join(map(chr, range(len(table))))):
        table[run.start() : run.end()] = True
    return table


def _symbols(joined: str) -> int:
    """The characters that are neither letters nor digits, in a text without its white space."""
    if joined.isascii():
        return len(joined.encode().translate(None, _ASCII_ALNUM))
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    if points.max() >= 1 << 16:
        return len(joined) - sum(map(len, _ALNUM.findall(joined)))
    return len(joined) - int(np.count_nonzero(_alphanumeric()[points]))


def describe(text: str | None, profiles: Profiles | None = None) -> dict:
    """All statistics of a text: see :func:`document_quality`."""
    return describe_all([text], profiles or default_profiles())[0]


def describe_all(texts: list[str | None], profiles: Profiles) -> list[dict]:
    """The statistics of many texts; the lines of all of them are compared with the profiles together."""
    out, counts, weights, rows, firsts = [], array("d"), [], [], []
    for text in texts:
        out.append(_none())
        if text is None or not text.strip():
            continue
        tokens = text.split()
        joined = "".join(tokens)
        dense = len(joined)
        plain = text if not _FULL_WIDTH.search(text) and unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFKC", text)
        if "<" in plain:
            plain = _INLINE_TAG.sub(" ", plain)
        if "[" in plain or "&" in plain or "**" in plain:
            plain = _INLINE_MARK.sub("", plain)
        lines = [ln for ln in (_LINES.split(plain) if _INNER_BREAK.search(plain) else plain.splitlines()) if ln and not ln.isspace()]
        bodies = [ln.strip() for ln in lines]
        repeated, seen, common, words = 1 - len(set(bodies)) / max(1, len(bodies)), set(), 0, 0
        if lines:
            rows.append(len(out) - 1)
            firsts.append(len(weights))
        for line, body in zip(lines, bodies):
            v, c, w = _short_line(line) if len(line) <= 60 and body not in seen else line_counts(line, repeated if body in seen else 0.0)  # short lines recur
            seen.add(body)
            counts.extend(v)
            weights.append(len(body) + LINE_CHARS)
            common, words = common + c, words + w
        out[-1] |= {
            "n_words": len(tokens),
            "mean_word_len": dense / len(tokens),
            "symbol_share": _symbols(joined) / dense,
            "punct_line_share": sum([b.rstrip(_CLOSERS).endswith(_ENDS) for b in bodies]) / max(1, len(bodies)),
            "common_share": common / max(1, words),
        }
    if not rows:
        return out
    near = profiles.nearest(np.frombuffer(counts).reshape(-1, len(CLASSES)))
    share, table = np.array(weights, float), STRUCTURES.index("table")
    mean = np.add.reduceat(near * share[:, None], firsts, axis=0) / np.add.reduceat(share, firsts)[:, None]
    of_table = np.add.reduceat((near.argmin(axis=1) == table).astype(int), firsts)
    mean[of_table < 2, table] = 1.0  # one row is no table: its cells are entries
    for row, least, kind in zip(rows, mean.min(axis=1).tolist(), mean.argmin(axis=1).tolist()):
        out[row] |= {"divergence": least, "kind": STRUCTURES[kind]}
    return out


def document_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: n_words, mean_word_len, symbol_share, punct_line_share, common_share, divergence, kind.

    Words are runs without white space; symbols are the characters that are
    neither letters, digits nor white space; common words are those of each
    line's best language.  ``kind`` is prose, list, table or junk, the nearest
    structure, and ``divergence`` the mean divergence to it.  Null, empty and
    blank texts have 0 words, null statistics and no kind; a text of tags alone
    has no kind.  Whole texts are read in one pass over the scan, without a
    shuffle; the profiles (a few thousand numbers) go along with the tasks.
    """
    src = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()
    profiles = default_profiles()
    cols = {"n_words": pa.int32(), "mean_word_len": pa.float64(), "symbol_share": pa.float64(), "punct_line_share": pa.float64(), "common_share": pa.float64(), "divergence": pa.float64(), "kind": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = describe_all(batch.column(1).to_pylist(), profiles)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[c] for r in rows], t) for c, t in cols.items())], names=[id_col, *cols])

    return src.mapInArrow(run, f"`{id_col}` {kind}, n_words int, mean_word_len double, symbol_share double, punct_line_share double, common_share double, divergence double, kind string")
