"""Problem 5: broken prompt and response pairs.

Languages of prompt and response are compared by the posteriors of a character
n-gram naive Bayes model; whether a response breaks off is judged from the
likelihood of its end under complete endings and under endings cut at chance,
beside open brackets, fences and list items.  Both models are fitted on a
bounded sample of the corpus.
"""

from __future__ import annotations

import math
import random
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.langdata import LANGUAGES, plain, training_lines
from lexloom.llm.wording import token_classes

DEFECTS = ("empty", "refusal", "copy", "other_language", "truncated")

# Placeholders that stand for no answer.
_PLACEHOLDERS = frozenset("none null nil nan na n/a undefined nocontent noanswer noresponse empty answer response a tbd todo pending blank 없음 빈응답 답변 응답 무응답 답변없음 내용없음 미정 무 nbsp 無 无".split())
_MARKUP = re.compile(r"<[^<>\n]{0,40}>|&[a-z]{2,6};|&#\d+;")
# Wordings that decline or find nothing.
_DECLINE = re.compile(
    r"제공하지 않|제공할 수 없|제공이 어렵|검색 ?결과가 없|결과를 찾을 수 없|정보를? ?찾(?:지 못|을 수 없)|자료를? ?찾(?:지 못|을 수 없)|문서를? ?찾(?:지 못|을 수 없)|문서가 (?:확인되지|없)|확인되지 않아 답|"
    r"권한 밖|말씀드리지 못|말씀드릴 수 없|도와드리기 어렵|도와드릴 수 없|도움을 드리(?:지 못|기 어렵)|자료가 없|정보가 없|안내가? ?(?:불가|어렵)|안내해? ?드리(?:지 못|기 어렵)|안내해? ?드릴 수 없|학습되지 않|"
    r"답(?:변)?을? 드리(?:지 못|기 어렵)|답변(?:해 ?드릴|드릴|할) 수 없|답변(?:이|을) ?(?:제한|거부|불가|어렵)|답변하기 어렵|답변드리기 어렵|알지 못합니다|모르겠습니다|지원하지 않는 (?:질문|주제)|"
    r"(?:can't|cannot|can ?not|won't|(?:not|un)able to|could(?:n't| not)) (?:help|assist|answer|provide|advise|find|locate|comment|share|disclose|respond|discuss)|(?:no|not any) (?:matching |relevant |related )?(?:document|information|result|record|answer|article|entr|data|material)\w* (?:\w+ ){0,3}(?:found|available|exist|match|on (?:this|that)|about|for)|"
    r"(?:found|find) no(?:thing| \w+)|nothing (?:was|could be) found|nothing (?:\w+ ){0,4}(?:covers?|about|on) |(?:is|are|was|were)n?(?: not|'t)? (?:not )?covered|polic(?:y|ies) (?:\w+ ){0,3}(?:rules? out|prohibits?|prevents?|forbids?|doesn't|does not)|(?:against|outside|beyond) (?:our|my|the) (?:polic|scope|remit|authority|knowledge|permission)|not (?:something )?(?:i|we)(?:'m| am| are) (?:able|allowed|permitted)|(?:not|n't) (?:been )?(?:trained|allowed|permitted|authori[sz]ed)|"
    r"(?:do not|don't) (?:have|know|provide|offer|cover|support|answer|discuss)|(?:not able|not possible|impossible) (?:for \w+ \w+ )?to|(?:access|assistant|portal|service|system) (?:does not|doesn't|cannot|can't) (?:cover|provide|answer|discuss|include|extend)|지원 대상이 아닙|대상이 아니|n't (?:any|have) information|have to decline|must decline|i am afraid i|"
    r"leider (?:kann|können|nicht|keine)|keine (?:informationen|dokumente|ergebnisse) (?:gefunden|vorhanden)|kann ich (?:leider )?nicht|désolé|aucun (?:document|résultat)|aucune information|lo siento|no se encontr|no puedo (?:ayudar|responder)|não (?:posso|foi encontrad|encontr)|desculpe|"
    r"申し訳|お答えでき|見つかりませんでした|抱歉|对不起|无法(?:回答|提供|帮助)|没有找到|未找到"
)
_APOLOGY = re.compile(r"죄송|양해 부탁|안타깝게도|유감|이해 바랍|감사하지만|감사합니다만|\bsorry\b|unfortunately|\bafraid\b|apolog|regret|thanks? (?:you )?for asking|^leider|désolé|lo siento|desculpe|申し訳|抱歉")
_COURTESY = re.compile(r"^(?:안녕하세요|안녕하십니까|반갑습니다|네|예|감사합니다|문의 ?(?:주셔서|해 ?주셔서)? ?감사|질문 ?감사|좋은 질문|잘 알겠습니다|hello|hi|dear|good (?:morning|afternoon|day|question)|thanks?|thank you|i (?:see|understand)|understood|that is|that's|great|sure|of course|let me (?:see|check|look)|one moment|please wait|hallo|danke|bonjour|merci|hola|gracias|olá|obrigad)")
_NEGATION = re.compile(r"않|없|못|아닙|아니|어렵|불가|제한|거부|(?:n't|\bnot|\bno|\bnothing|\bnone|cannot|unable|decline|refuse|\bnever|outside|beyond|rules? out)\b|nicht|kein|\bpas\b|aucun|não|nenhum|ません|ない|不|无法|没有")
_QUOTED = re.compile(r"(?<!\w)'[^'\n]{2,90}'(?![a-zA-Z])|\"[^\"\n]{2,90}\"|“[^”\n]{2,90}”|‘[^’\n]{2,90}’|「[^」\n]{2,90}」|『[^』\n]{2,90}』|`[^`\n]{2,90}`")
# Wordings around a question that is only given back.
_ECHO = re.compile(r"라고 ?(?:문의|질문|물어|말씀)\S*(?: ?주?\S*니다)?|(?:문의|질문)(?:에|에 대해)? ?(?:답변|안내|회신)\S*|(?:문의|질문)(?: 내용)?(?:입니다|이군요|하셨습니다|주셨습니다)|you (?:asked|wrote|want to know|would like to know)(?: about)?|(?:the|this|your) question (?:is|was|reads?)(?: about)?|your (?:question|request|query)(?: was| is)?|(?:the )?question ?:|^(?:q|질문|문의)\s*[:.)]|answer ?:|답변 ?:|thank you for (?:your question|asking)")
# How a prompt asks for a language.
_ASKED = {
    "en": r"영어로|영문으로|in english|auf englisch|en anglais|en inglés|em inglês|英語で|用英[语文]",
    "ko": r"한국어로|한글로|국문으로|in korean|韓国語で|用韩[语文]",
    "ja": r"일본어로|일어로|in japanese|日本語で|用日[语文]",
    "zh": r"중국어로|in chinese|中国語で|用中文",
    "de": r"독일어로|독어로|in german|auf deutsch",
    "fr": r"프랑스어로|불어로|in french|en français",
    "es": r"스페인어로|in spanish|en español",
    "pt": r"포르투갈어로|in portuguese|em português",
}
_ASKED_RE = {lang: re.compile(p) for lang, p in _ASKED.items()}
_ANY_LANGUAGE = re.compile(r"번역|translat|übersetz|traduc|翻訳|翻译")
_SENTENCE = re.compile(r"(?<=[.!?。])\s+|\n+")
_FINAL = re.compile(r"[.!?。！？][\"'”’)\]」』]*$")
_MARKER = re.compile(r"^\s*(?:\d{1,2}[.)]|\(\d{1,2}\)|[-*•])\s*$")
_ITEM = re.compile(r"^\s*(?:\d{1,2}[.)]|\(\d{1,2}\)|[-*•])\s+\S")
_ITEM_MARK = re.compile(r"^\s*(?:\d{1,2}[.)]|\(\d{1,2}\)|[-*•])\s+")
_TOPIC = re.compile(r"[가-힣A-Za-z](?:은|는|을|를)(?= |$)")
# Endings of Korean answers in the nominal style.
_NOMINAL = re.compile(r"(?:다|요|음|됨|함|것|불필요|필요|가능|실행|없음|있음)$")
MARK_ODDS = -9.0  # what each mark of an unfinished text takes from the log-odds that it is complete
SHORT_ODDS = 4.0  # log-odds that an answer which is no sentence is complete
_LOGGED = 200  # the logger cuts answers at so many characters and adds " ..."


_NO_LETTER = re.compile(r"[\W\d_]")


class NgramBayes:
    """Character n-gram naive Bayes over languages: one row of log-likelihoods per known n-gram (orders 1 to 3)."""

    def __init__(self, lines: dict[str, list[str]], orders: int = 3):
        self.langs, self.orders = tuple(lines), orders
        if orders > 3:
            raise ValueError("n-grams of more than three characters would reach over whole words")
        self.places: dict[str, int] = {}  # sums by word, kept in a table
        self.sums = np.zeros((1 << 10, len(self.langs) + 1))
        counts = []
        for lang in self.langs:
            text = "\n".join(plain(x) for x in lines[lang])
            counts.append(Counter(g for line in text.split("\n") for g in self._grams(line)))
        grams = sorted({g for c in counts for g, n in c.items()})
        self.index = {g: i for i, g in enumerate(grams)}
        table = np.array([[c[g] for c in counts] for g in grams], np.float64) + 0.3
        self.table = np.log(table / table.sum(axis=0)).astype(np.float32)

    def _grams(self, line: str) -> list[str]:
        line = f" {line} "
        return [line[i : i + k] for k in range(1, self.orders + 1) for i in range(len(line) - k + 1)]

    def _place(self, key: str) -> int:
        """Row of the sums over the n-grams that end in a word or in the blank after it; ``key``: the letter before the word's blank, the blank and the word."""
        if len(self.places) == len(self.sums):
            if len(self.places) >= 1 << 18:
                self.places.clear()
            else:
                self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        s, first = f"{key} ", key.index(" ") + 1
        rows = [r for end in range(first + 1, len(s) + 1) for k in range(1, min(self.orders, end) + 1) if (r := self.index.get(s[end - k : end])) is not None]
        at = self.places[key] = len(self.places)
        self.sums[at, :-1] = self.table[rows].sum(axis=0)
        self.sums[at, -1] = len(rows)
        return at

    def posteriors(self, text: str) -> tuple[dict[str, float], int]:
        """Posterior of each language, and the letters it rests on; n-grams overlap, so their weight is tempered.

        The sum over the n-grams goes word by word, as words recur; an n-gram
        of up to three characters reaches at most one letter back over the
        blank before a word.
        """
        low = plain(text)
        before, at = "", []
        for word in low.split(" "):
            key = f"{before} {word}"
            place = self.places.get(key)
            at.append(self._place(key) if place is None else place)
            before = word[-1:]
        total = self.sums[at].sum(axis=0)
        blank = self.index.get(" ")
        if blank is not None:  # the blank before the first word
            total[:-1] += self.table[blank]
            total[-1] += 1
        if not total[-1]:
            return {}, 0
        odds = np.exp((total[:-1] - total[:-1].max()) / self.orders)
        return dict(zip(self.langs, (odds / odds.sum()).tolist())), len(low) - len(_NO_LETTER.findall(low))


class EndModel:
    """Log-likelihood ratio of how a text ends: complete endings against endings cut at chance, both taken from the sample's sentences.

    An ending is its final stop, or the lack of one, and the last characters
    before it.  How often a complete sentence lacks its stop is not read off
    the sample, where lines are broken anywhere, but taken as ``careless`` and
    updated by the other sentences of the same text.  The bound below which a
    text breaks off is the one with fewest errors on sentences held out of the
    counts.
    """

    LONGEST = 6

    def __init__(self, lines: dict[str, list[str]], seed: int = 7, careless: float = 0.02, held_out: float = 0.2):
        rng = random.Random(seed)
        self.careless = careless
        whole, cut, stops = Counter(), Counter(), Counter()
        self.n_whole = self.n_cut = 0
        tests: list[tuple[bool, str]] = []
        for lang in sorted(lines):
            for line in lines[lang]:
                for s in _SENTENCE.split(line.strip()):
                    s = s.strip()
                    if len(s) < 12 or not _FINAL.search(s):
                        continue
                    bare = _FINAL.sub("", s)
                    words = [i for i, c in enumerate(bare) if c == " "] if " " in bare else range(4, len(bare) - 2)
                    cuts = [s[: rng.choice(words) if words and rng.random() < 0.7 else rng.randrange(4, len(s) - 2)].rstrip() for _ in range(4)]
                    if rng.random() < held_out:
                        tests += [(True, s if rng.random() >= careless else bare), (False, cuts[0])]
                        continue
                    self.n_whole += 2
                    whole.update(self._ends(bare) * 2)
                    for c in cuts:
                        self.n_cut += 1
                        stops[bool(_FINAL.search(c))] += 1
                        cut.update(self._ends(_FINAL.sub("", c)))
        self.stop_cut = (stops[True] + 0.5) / (self.n_cut + 1)
        self.ratio = {g: (math.log((whole[g] + 0.5) / (self.n_whole + 1)) - math.log((cut[g] + 0.5) / (self.n_cut + 1)), whole[g] + cut[g]) for g in whole.keys() | cut.keys()}
        self.bound, self.held_out_errors = self._fit_bound([(ok, self.log_odds(t)) for ok, t in tests])

    @staticmethod
    def _fit_bound(scored: list[tuple[bool, float]]) -> tuple[float, float]:
        """Middle of the bounds with fewest errors, and the share of errors there."""
        if not scored:
            return 0.0, 0.0
        scored = sorted(scored, key=lambda x: x[1])
        errors = sum(not ok for ok, _ in scored)  # all taken as complete
        best, places = errors, [0]
        for k, (ok, _) in enumerate(scored, 1):
            errors += 1 if ok else -1
            if errors < best:
                best, places = errors, [k]
            elif errors == best:
                places.append(k)
        edges = [-20.0, *(x for _, x in scored), 20.0]
        k = places[len(places) // 2]
        return (edges[k] + edges[k + 1]) / 2, best / len(scored)

    def _ends(self, text: str) -> list[str]:
        low = re.sub(r"\d+", "0", text[-20:].casefold())
        return [low[-k:] for k in range(1, self.LONGEST + 1) if len(low) >= k]

    def suffix(self, text: str) -> float:
        """Ratio of the longest known end without its stop."""
        got = 0.0
        for g in self._ends(_FINAL.sub("", text.rstrip())):
            hit = self.ratio.get(g)
            if hit and hit[1] >= 4:
                got = hit[0]
        return got

    def log_odds(self, text: str, stopped: int = 0, open_ended: int = 0) -> float:
        """Of complete to broken off; ``stopped`` and ``open_ended``: other sentences of the text with and without a final stop."""
        lacking = (open_ended + 2 * self.careless) / (stopped + open_ended + 2)
        if _FINAL.search(text.rstrip()):
            return math.log((1 - lacking) / self.stop_cut) + self.suffix(text)
        return math.log(lacking / (1 - self.stop_cut)) + self.suffix(text)


class PairJudge:
    """All models, and the verdict on one pair."""

    def __init__(self, lines: dict[str, list[str]]):
        self.languages, self.ends = NgramBayes(lines), EndModel(lines)

    def verdict(self, prompt: str | None, response: str | None) -> str | None:
        """The first defect that fits, or None."""
        prompt = unicodedata.normalize("NFKC", prompt or "").strip()
        raw = response or ""
        answer = unicodedata.normalize("NFKC", re.sub("[​-‏⁠﻿­]", "", raw)).strip()
        if self._empty(answer):
            return "empty"
        if self._refusal(answer):
            return "refusal"
        if prompt and self._copy(prompt, answer):
            return "copy"
        if prompt and self._other_language(prompt, answer):
            return "other_language"
        if not self._logger_cut(raw) and self._truncated(answer):
            return "truncated"
        return None

    @staticmethod
    def _logger_cut(raw: str) -> bool:
        return len(raw) >= _LOGGED + 3 and raw.endswith(" ...")

    @staticmethod
    def _empty(answer: str) -> bool:
        bare = re.sub(r"[\W_]+", "", _MARKUP.sub("", answer).casefold())
        return not bare or bare in _PLACEHOLDERS or answer.casefold().strip(" .:-") in _PLACEHOLDERS

    @staticmethod
    def _refusal(answer: str) -> bool:
        """Whether an answer declines: after its courtesies, however many, it opens by declining, or with an apology and declines later."""
        said = _QUOTED.sub(" Q ", answer.casefold().replace("’", "'"))
        parts = [p for p in _SENTENCE.split(said) if p.strip()]
        opening = next((i for i, p in enumerate(parts) if not _COURTESY.search(p) or _DECLINE.search(p) or _APOLOGY.search(p)), 0)
        parts = parts[opening:]
        hits = [bool(_DECLINE.search(p)) for p in parts]
        sorry = any(_APOLOGY.search(p) for p in parts[:2])
        if sorry and (any(hits) or any(_NEGATION.search(p) for p in parts[:2])):
            return True
        return bool(hits) and (hits[0] or (len(hits) in (2, 3) and hits[1]))

    @staticmethod
    def _copy(prompt: str, answer: str) -> bool:
        squeeze = lambda s: re.sub(r"[\W_]+", "", s)
        q, rest = squeeze(prompt.casefold()), squeeze(_ECHO.sub(" ", answer.casefold()))
        if len(q) < 6:
            return False
        if not rest or rest == q:
            return True
        if q in rest:
            return len(rest.replace(q, "")) <= max(3, 0.12 * len(q))
        if rest in q:
            return len(rest) >= 0.4 * len(q) and len(rest) >= 10
        words, own = set(re.findall(r"\w+", prompt.casefold())), re.findall(r"\w+", _ECHO.sub(" ", answer.casefold()))
        return len(own) >= 3 and sum(w in words for w in own) >= 0.85 * len(own) and len(rest) >= 0.6 * len(q)

    def _other_language(self, prompt: str, answer: str) -> bool:
        low = prompt.casefold()
        if _ANY_LANGUAGE.search(low):
            return False
        wanted = next((lang for lang, p in _ASKED_RE.items() if p.search(low)), None)
        post, letters = self.languages.posteriors(_QUOTED.sub(" ", answer) if len(answer) > 60 else answer)
        if letters < 8 or not post:
            return False
        best = max(post, key=post.get)
        if wanted is None:
            of_prompt, n = self.languages.posteriors(prompt)
            if n < 6 or not of_prompt:
                return False
            wanted = max(of_prompt, key=of_prompt.get)
            if of_prompt[wanted] < 0.9:
                return False
        if best == wanted or post[best] < 0.98:
            return False
        if best in ("ko", "ja", "zh") or wanted in ("ko", "ja", "zh"):
            wide = sum("가" <= c <= "힣" or "぀" <= c <= "ヿ" or "一" <= c <= "鿿" for c in plain(answer))
            if best not in ("ko", "ja", "zh"):  # Latin words alone may be names or a command
                return wide * 8 < letters and (token_classes(answer)[1][0] >= 2 or letters >= 60 or bool(_FINAL.search(answer) and letters >= 20))
            return wide * 2 >= letters or wide >= 12
        return letters >= 16 and token_classes(answer)[1][0] >= 2

    def _truncated(self, answer: str) -> bool:
        """Whether an answer breaks off: the log-likelihood ratio of its end, with what marks of an unfinished text take from it, is below the fitted bound."""
        return self.completeness(answer) < self.ends.bound

    def completeness(self, answer: str) -> float:
        """Log-odds that an answer is finished."""
        lines = [x for x in answer.split("\n") if x.strip()]
        last = lines[-1].strip()
        item = _ITEM_MARK.match(last)
        parts = [p for p in _SENTENCE.split(last[item.end() :] if item else last) if p.strip()]
        end = parts[-1].strip() if parts else ""
        # other sentences of the text: among items only items tell how sentences end there
        others = [p for x in lines[:-1] if not item or _ITEM_MARK.match(x.strip()) for p in _SENTENCE.split(_ITEM_MARK.sub("", x.strip())) if p.strip()] + parts[:-1]
        others = [p.strip() for p in others if _FINAL.search(p.strip()) or self._running(p)]
        marks = self._open_marks(answer, lines) + bool(item and others and len(end) * 2 * len(others) < sum(map(len, others)))
        stopped = sum(bool(_FINAL.search(p)) for p in others)
        if _FINAL.search(end) or others or self._running(end):
            odds = self.ends.log_odds(end, stopped, len(others) - stopped)
        else:  # an entry, a name or a command has no stop to lack
            odds = SHORT_ODDS
            if not item and len(end.split()) > 1:
                odds += min(0.0, self.ends.suffix(end)) * (token_classes(end)[1][0] > 1)
                marks += bool(_TOPIC.search(end) and not _NOMINAL.search(end))
        return odds + MARK_ODDS * marks

    @staticmethod
    def _running(part: str) -> bool:
        """Whether a part is a sentence rather than an entry, a name or a command."""
        lang, counts = token_classes(part)
        return counts[0] >= 1 and (len(part.split()) >= 4 or (lang in ("ja", "zh") and len(part) >= 8))

    @staticmethod
    def _open_marks(answer: str, lines: list[str]) -> int:
        """Marks of an unfinished text: an open fence or bracket, dots, a mark that something follows, an empty last item."""
        return sum((
            answer.count("```") % 2 == 1,
            bool(re.search(r"(?:\.{2,}|…)$", answer)),
            bool(re.search(r"[,(\[{=\-–—/:&+]$|(?:^|\s)[\"'“‘(\[]$", answer)) and not re.search(r"(?:^|\s)\S*[/\\]\S*[/\\]$", answer),
            len(lines) > 1 and bool(_MARKER.match(lines[-1])),
            any(answer.rfind(a) > answer.rfind(b) for a, b in ("()", "[]", "“”", "「」")) and len(answer) > 30 and not re.search(r"(?:^|\s)[:;]\($", answer),
        ))


def fit_judge(corpus: DataFrame, **bounds) -> PairJudge:
    """Models from a bounded sample of labelled rows; see :func:`lexloom.llm.langdata.training_lines` for the bounds."""
    return PairJudge(training_lines(corpus, **bounds))


def broken_pairs(pairs: DataFrame, judge: PairJudge, id_col: str = "entry_id", prompt_col: str = "question", response_col: str = "portal_answer_snippet", order_col: str = "logged_at") -> DataFrame:
    """``(entry_id, defect)``: each distinct broken pair with the first defect that fits.

    Of rows that share an id the latest counts (ties by the greatest values);
    rows without an id are left out.  A null, blank or placeholder response is
    ``empty``; a null or blank prompt leaves only ``empty``, ``refusal`` and
    ``truncated`` possible.  The system's own ``has_answer`` is not read.
    """
    spark = pairs.sparkSession
    shared = spark.sparkContext.broadcast(judge)
    best = F.max(F.struct(F.col(order_col).alias("o"), F.col(prompt_col).alias("q"), F.col(response_col).alias("a"))).alias("_best")
    rows = pairs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), order_col, prompt_col, response_col).groupBy("_id").agg(best).select("_id", "_best.q", "_best.a")
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.verdict(q, a) for q, a in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            keep = [i for i, d in enumerate(found) if d]
            if keep:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array([found[i] for i in keep])], names=[id_col, "defect"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, defect string")
