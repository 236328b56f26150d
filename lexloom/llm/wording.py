"""Function words of the languages, and the classes of tokens by which lines are told apart."""

from __future__ import annotations

import re
from functools import lru_cache

# Common words of each language.
COMMON = {
    "en": "the a an of to in and is are was were be been it its that this these those for on with as at by from or not but if no than then so which who what when where why how has have had will would can could may must should do does did there their they them he she his her we our us you your i my me one two all each every any some only also after before during until while because although into over under about between again more most other such very please still both",
    "de": "der die das den dem des ein eine einen einem einer und oder aber nicht ist sind war waren wird werden wurde wurden hat haben hatte mit von vom zu zum zur im in am an auf aus bei beim bis durch für über unter vor nach ohne um als wie wenn dass weil so auch nur noch schon sehr sich sie er es wir ihr man kein keine mehr dann dort hier was wer wo trotzdem jede jeder jedes muss sehen",
    "fr": "le la les l un une des du de d et ou mais ne pas n est sont était étaient sera être a ont avait avec sans sur sous dans par pour en au aux ce cet cette ces que qu qui quoi dont où il elle ils elles on nous vous je se sa son ses leur leurs plus moins très aussi après avant pendant jusqu si comme quand parce tout toute tous chaque aussi toujours faut y voir suffit",
    "es": "el la los las lo un una unos unas y o pero no es son era eran fue fueron ser está están ha han había con sin sobre en por para de del al a que qué quien cual cuando donde como se su sus le les me te nos más menos muy también ya si porque todo toda todos cada este esta estos estas ese esa después antes durante hasta según sigue ahí tiene basta necesita",
    "pt": "o a os as um uma uns umas e ou mas não é são era eram foi foram ser está estão há havia com sem sobre em no na nos nas por para pelo pela de do da dos das ao à que quem qual quando onde como se seu sua seus suas mais menos muito também já porque todo toda todos cada este esta esse essa depois antes durante até segundo basta precisa pode tem ainda assim",
}
# Particles and endings that close a Korean word in running text, and function characters of Japanese and Chinese.
KOREAN_END = ("은", "는", "을", "를", "에", "에서", "에게", "의", "와", "과", "로", "도", "만", "까지", "부터", "보다", "마다", "다", "요", "니다", "고", "면", "지만", "므로", "려면", "때", "뒤", "수", "것", "및", "한", "할", "된", "될", "있는", "없는", "하는", "되는", "이", "가")
KOREAN_FREE = frozenset("및 그 이 저 것 수 때 뒤 후 등 또는 그리고 하지만 누가 모두 함께 다시 먼저 따로 더 자주 잘못 잠시 그대로 약 두 세 한 개가 없다 있다 경우 이유로 사실을 참고로 보통 현재 처음에는 예전".split())
JAPANESE = frozenset("はがをにのでともへやかられてたですますいないする")
CHINESE = frozenset("的了在是不我有和就要把被从也都与为对这那但所以因着过并且怎样请用到会已经没每个")
_COMMON_OF: dict[str, str] = {}  # word -> its languages
for _lang, _words in COMMON.items():
    for _word in set(_words.split()):
        _COMMON_OF[_word] = f"{_COMMON_OF[_word]} {_lang}" if _word in _COMMON_OF else _lang

EDGES = "\"'.,:;!?()[]{}<>«»“”„‘’…·。、，；：！？（）「」『』*_#`~"
_APOSTROPHE = re.compile(r"['’\-]")
NUMBER = re.compile(r"\d[\d.,:/-]*")
_HANGUL_TAIL = re.compile(r"[가-힣]+$")
CJK = re.compile(r"[぀-ヿ一-鿿]")
KANA = re.compile(r"[぀-ヿ]")
HANGUL = re.compile(r"[가-힣]")


@lru_cache(maxsize=1 << 18)
def token_class(token: str) -> tuple[str, int]:
    """Languages (space separated) in which a token is a common word, and its class: 1 word, 2 number or code, 3 mark; cached, as tokens recur."""
    if len(token) == 1 and token.isupper() and token not in "AIO":  # a mark in a cell, no word
        return "", 3
    word = token.lower().strip(EDGES)
    if not word:
        return "", 2 if any(map(str.isalnum, token)) else 3
    if HANGUL.search(word):
        word = _HANGUL_TAIL.search(word)
        tail = word[0] if word else ""
        return ("ko", 1) if tail in KOREAN_FREE or (len(tail) > 1 and tail.endswith(KOREAN_END)) else ("", 1)
    if not any(map(str.isalpha, word)) or (any(map(str.isdigit, word)) and not word.isalpha()):
        return "", 2
    if word.isalpha():
        return _COMMON_OF.get(word, ""), 1
    langs = {lang for part in _APOSTROPHE.split(word) for lang in _COMMON_OF.get(part, "").split()}
    return " ".join(lang for lang in COMMON if lang in langs), 1


def east_asian(line: str) -> tuple[str, int, int]:
    """``ja`` or ``zh`` with the characters of its scripts and those that are function characters, or an empty language."""
    if not line.isascii() and CJK.search(line):
        cjk = CJK.findall(line)
        if len(cjk) * 2 > len(HANGUL.findall(line)) * 2 + len(line) * 0.5:
            lang, chars = ("ja", JAPANESE) if KANA.search(line) else ("zh", CHINESE)
            return lang, len(cjk), sum(c in chars for c in cjk)
    return "", 0, 0


def token_classes(line: str) -> tuple[str, tuple[int, int, int, int]]:
    """Best language of a line and its counts of common words, other words, numbers or codes, and marks."""
    lang, cjk, hits = east_asian(line)
    if lang:
        return lang, (hits, cjk - hits, len(NUMBER.findall(line)), 0)
    of = [0, 0, 0, 0]
    hits: dict[str, int] = {}
    for langs, kind in map(token_class, line.split()):
        of[kind] += 1
        if langs:
            hits[langs] = hits.get(langs, 0) + 1
    if not hits:
        return "en", (0, of[1], of[2], of[3])
    lang, common = best_language(hits)
    return lang, (common, of[1] - common, of[2], of[3])


def best_language(hits: dict[str, int]) -> tuple[str, int]:
    """The language with most common words, and their number; ``hits``: common words by the languages (space separated) that have them."""
    by: dict[str, int] = {}
    for langs, n in hits.items():
        for lang in langs.split():
            by[lang] = by.get(lang, 0) + n
    return max(by.items(), key=lambda x: (x[1], x[0]))
