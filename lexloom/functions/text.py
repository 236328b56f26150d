"""Text scalars as column expressions; all of them run inside the JVM.

Null text gives null from the scalar functions and an empty array from the
tokenisers, unless a function says otherwise.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.constants import SYNONYMS

HANGUL = "가-힣"


def simple_tokens(text: Column) -> Column:
    """Lower-cased words of two or more ASCII letters and digits that stand between Unicode word boundaries; repeats stay, null gives []."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+")
    return F.filter(words, lambda w: w.rlike("^[a-z0-9]{2,}$"))


def normalize_token(token: Column) -> Column:
    """Trimmed, lower case, without edge '#', white space as '_', and only digits, ASCII letters, Hangul, '_', '-' and '.' kept."""
    t = F.regexp_replace(F.lower(trim_space(token)), "^#+|#+$", "")
    return F.regexp_replace(F.regexp_replace(t, r"\s+", "_"), rf"[^0-9a-z_{HANGUL}\-.]+", "")


def _normal(token: str) -> str:
    return re.sub(r"[^0-9a-z_가-힣\-.]+", "", re.sub(r"\s+", "_", token.strip().lower().strip("#")))


def synonym_map() -> dict[str, str]:
    """Alias to canonical spelling; the first canonical that claims an alias keeps it, canonical words map to themselves."""
    out: dict[str, str] = {}
    for canonical, aliases in SYNONYMS.items():
        for form in (canonical, *map(_normal, aliases)):
            out.setdefault(form, canonical)
    return out


def apply_synonyms(token: Column) -> Column:
    """Canonical spelling of a normalised token, the token itself where none is known."""
    known = {form: canonical for form, canonical in synonym_map().items() if form != canonical}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.when(token.isin(*known), F.element_at(table, token)).otherwise(token)  # the set is looked up by hash, the map only for hits


def tagging_tokens(text: Column, synonyms: bool = True) -> Column:
    """Tokens of the taggers, in order: runs of ASCII letters, digits and '_', or of two or more Hangul syllables; pure digits and single characters are dropped; null gives []."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"([A-Za-z0-9_]+|[{HANGUL}]{{2,}})"), F.lit(1))
    kept = F.filter(F.transform(found, F.lower), lambda t: (F.length(t) >= 2) & ~t.rlike("^[0-9]+$"))
    return F.transform(kept, apply_synonyms) if synonyms else kept


def guess_language(text: Column) -> Column:
    """ko with any Hangul syllable, else en with any ASCII letter, else unknown (null too)."""
    return F.when(text.rlike(f"[{HANGUL}]"), "ko").when(text.rlike("[A-Za-z]"), "en").otherwise("unknown")


def trim_space(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalize_text(text: Column) -> Column:
    """Line ends as LF, runs of blanks and tabs as one blank, at most one empty line in a row, trimmed."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return trim_space(t)


def normalize_tag(tag: Column) -> Column:
    """Trimmed, one leading '#' off, white space as '_', lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(trim_space(tag), "^#", ""), r"\s+", "_"))


def normalize_tags(csv: Column) -> Column:
    """Distinct normalised tags of a comma-separated list, sorted; null gives []."""
    tags = F.transform(F.split(F.coalesce(csv, F.lit("")), ","), normalize_tag)
    return F.array_sort(F.array_distinct(F.filter(tags, lambda t: t != "")))


def hashtag_line(tags: Column) -> Column:
    """Tags as '#a #b'."""
    return F.array_join(F.transform(tags, lambda t: F.concat(F.lit("#"), t)), " ")


def normalize_phrase(phrase: Column) -> Column:
    """Tagging tokens of a phrase joined by '_'; '' where under two characters."""
    p = F.array_join(tagging_tokens(phrase), "_")
    return F.when(F.length(p) >= 2, p).otherwise("")


def normalize_key(phrase: Column) -> Column:
    """Key under which spellings of a phrase meet: one blank between words, no punctuation at the ends, lower case, '_' as blank."""
    p = F.regexp_replace(trim_space(phrase), r"\s+", " ")
    p = F.regexp_replace(p, r"""^[.,;:!?()\[\]{}"'\-]+|[.,;:!?()\[\]{}"'\-]+$""", "")
    return trim_space(F.regexp_replace(F.translate(F.lower(p), "_", " "), r"\s+", " "))


def clean_lines(text: Column, most: int | None = None) -> Column:
    """Trimmed lines without those of one character or of one to three digits, each line once; cut at ``most`` characters with a notice where given."""
    lines = F.transform(F.split(text, r"\r\n|\r|\n"), trim_space)
    kept = F.array_distinct(F.filter(lines, lambda x: (F.length(x) > 1) & ~x.rlike("^[0-9]{1,3}$")))
    joined = F.array_join(kept, "\n")
    if most is None:
        return joined
    return F.when(F.length(joined) > most, F.concat(F.substring(joined, 1, most), F.lit("\n...(truncated)"))).otherwise(joined)


def clean_controls(text: Column) -> Column:
    """Control characters other than LF, CR and TAB as blanks, runs of white space as one blank; '' where under ten characters remain, and for null."""
    t = trim_space(F.regexp_replace(F.regexp_replace(text, r"[\p{C}&&[^\n\r\t]]", " "), r"\s+", " "))
    return F.when(F.length(t) >= 10, t).otherwise("")


def ascii_ratio(text: Column) -> Column:
    """Share of ASCII characters; 1.0 for empty text."""
    n = F.length(text)
    return F.when(n == 0, 1.0).otherwise(F.length(F.regexp_replace(text, r"[^\x00-\x7F]", "")) / n)


def safe_filename(text: Column, most: int = 20) -> Column:
    """The first ``most`` characters without all but letters, digits, blanks, '_' and '-', blanks as '_'."""
    return F.translate(trim_space(F.regexp_replace(F.substring(text, 1, most), r"[^\p{L}\p{N} _\-]", "")), " ", "_")


def slug(text: Column, most: int = 40) -> Column:
    """Lower-case letters and digits with '-' between, at most ``most`` characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^0-9a-z가-힣]+", "-"), "^-+|-+$", ""), 1, most)


def positions(text: Column, needle: str, first: int = 3) -> Column:
    """0-based starts of the first occurrences of ``needle``, whatever its case, not overlapping; text is cut at the needle, so one pass does."""
    parts = F.split(F.lower(text), re.escape(needle.lower()))
    at = lambda i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x)) + (i - 1) * len(needle)
    hits = F.least(F.size(parts) - 1, F.lit(first))
    return F.when(hits > 0, F.transform(F.sequence(F.lit(1), hits), at)).otherwise(F.array().cast("array<int>"))


def snippets(text: Column, starts: Column, size: int, margin: int = 20) -> Column:
    """Windows of ``margin`` characters around spans of ``size`` that start at ``starts``."""
    return F.transform(starts, lambda p: F.substring(text, F.greatest(p - margin, F.lit(0)) + 1, F.least(p, F.lit(margin)) + size + margin))


def id_hash(prefix: str, size: int, *parts: Column) -> Column:
    """Deterministic key: prefix and the first ``size`` hexadecimal digits of the parts' SHA-256, joined by '|'; null parts count as ''."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, size))


def record_key(title: Column, text: Column) -> Column:
    """Key of a record whatever its path and time."""
    return id_hash("rk_", 24, F.lower(trim_space(F.coalesce(title, F.lit("")))), F.lower(normalize_text(F.coalesce(text, F.lit("")))))


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over that of the union of two arrays; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def loose_position(sentence: Column, phrase: Column) -> Column:
    """0-based place of a phrase in a sentence that has all of its words, in any order and case; -1 elsewhere."""
    low = F.lower(sentence)
    words = F.filter(F.split(F.lower(phrase), r"\s+"), lambda w: w != "")
    there = F.forall(words, lambda w: low.contains(w)) & (F.size(words) > 0)
    return F.when(there, F.array_min(F.transform(words, lambda w: F.instr(low, w))) - 1).otherwise(-1)


def over_best(score: Column, best: Column) -> Column:
    """Score over the best one; unchanged where the best is not positive."""
    return F.when(best > 0, score / best).otherwise(score)
