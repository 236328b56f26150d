"""Language labels, and the bounded training sample that the language models are fitted on."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.llm.seeds import SEED
from lexloom.llm.wording import token_classes

LANGUAGES = ("ko", "en", "ja", "zh", "de", "fr", "es", "pt")

# Names and codes of the languages (lower case).
_NAMES = {
    "ko": "ko kor korean korea kr 한국어 한글 한국말 coreano koreanisch coréen 韓国語 韩语 朝鲜语",
    "en": "en eng english 영어 englisch anglais inglés ingles inglês 英語 英语 英文",
    "ja": "ja jpn jp japanese 일본어 日本語 日语 日文 japanisch japonais japonés japonês",
    "zh": "zh zho chi cn chinese mandarin cmn zh-hans zh-hant 중국어 中文 汉语 漢語 中国語 chinesisch chinois chino chinês",
    "de": "de deu ger german deutsch 독일어 ドイツ語 德语 allemand alemán alemão",
    "fr": "fr fra fre french français francais 프랑스어 불어 フランス語 法语 französisch francés francês",
    "es": "es spa spanish español espanol castellano 스페인어 スペイン語 西班牙语 spanisch espagnol espanhol",
    "pt": "pt por portuguese português portugues 포르투갈어 ポルトガル語 葡萄牙语 portugiesisch portugais portugués",
}
NAMELESS = "|und|unknown|unk|n/a|na|none|null|nan|auto|mul|mis|zxx|xx|other|?|-|--|undefined|unspecified|미상|알 수 없음|없음|기타"
LABELS = {name: lang for lang, names in _NAMES.items() for name in names.split()}

_CODE_SIGNS = r"0-9/\\_@=<>{}|#"
_CODE = re.compile(rf"(?<![!-~])(?:(?![{_CODE_SIGNS}])[!-~])*+[{_CODE_SIGNS}][!-~]*+")  # starts at the first of a run's characters only, so it is linear
_SPACE = re.compile(r"\s+")


def plain(text: str) -> str:
    """A line without codes, paths and numbers, in lower case, with single blanks."""
    return _SPACE.sub(" ", _CODE.sub(" ", unicodedata.normalize("NFC", text))).casefold().strip()


def label_language(label: Column) -> Column:
    """Language that a label names, whatever its spelling or country; '' for a label that names none; the label itself for another language."""
    low = F.lower(F.trim(F.regexp_replace(label, r"[\s 　]+", " ")))
    base = F.regexp_extract(low, r"^([^\s_\-(.;,@]+)", 1)
    names = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.when(label.isNull() | low.isin(*NAMELESS.split("|")), F.lit("")).otherwise(F.coalesce(F.element_at(names, low), F.element_at(names, base), low))


def training_lines(corpus: DataFrame, rows_per_language: int = 250, chars_per_row: int = 2000, text_col: str = "text", label_col: str = "lang_label", id_col: str = "doc_id") -> dict[str, list[str]]:
    """Lines per language from a bounded sample of labelled rows (by hash of the id), plus the seed sentences.

    At most ``rows_per_language`` rows of a language, ``chars_per_row``
    characters of each, reach the driver; all rows stand for election: they
    are counted by language, and only those with a hash below a share of that
    count, a few times the wanted number, are sorted.  Lines
    that disagree with their label by script or common words are left out, as
    labels may be wrong and texts mixed.
    """
    labelled = corpus.select(label_language(F.col(label_col)).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("h")).where(F.col("lang").isin(*LANGUAGES) & (F.length("text") > 20))
    many = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not many:
        return {lang: SEED[lang].split(". ") for lang in LANGUAGES}
    # so many times the wanted rows are below these hashes that the wanted ones are among them; next to nothing is left to sort
    reach = {lang: min(1.0, (4 * rows_per_language + 100) / n) for lang, n in many.items()}
    below = F.create_map(*[F.lit(x) for lang, share in reach.items() for x in (lang, min((1 << 63) - 1, int((share - 0.5) * 2**64)))])
    few = labelled.where(F.col("h") <= below[F.col("lang")]).withColumn("text", F.substring("text", 1, chars_per_row))
    first = W.partitionBy("lang").orderBy("h", "text")
    rows = few.withColumn("n", F.row_number().over(first)).where(F.col("n") <= rows_per_language).select("lang", "text").collect()
    out = {lang: SEED[lang].split(". ") for lang in LANGUAGES}
    for lang, text in sorted(map(tuple, rows)):
        for line in text.split("\n"):
            got, counts = token_classes(line)
            if got == lang and counts[0] >= 2:
                out[lang].append(line)
    return out
