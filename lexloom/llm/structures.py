"""Lines of each text structure, from which the structural profiles are measured.

Prose comes from the seed sentences: runs and paragraphs of them, parts as line
breaks leave them, and the same with broken spacing.  Lists, tables and junk are put
together by chance from the seeds' content words, numbers and codes, a form
after another, so that no profile rests on the texts that are judged.
"""

from __future__ import annotations

import random
import re
import string

from lexloom.llm.seeds import SEED
from lexloom.llm.wording import CHINESE, token_class

STRUCTURES = ("prose", "list", "table", "junk")
SPACELESS = ("ja", "zh")
# Characters that stand for lost or scrambled content, and neighbouring keys.
_SYMBOLS = "#:~>_|/.*+=-<?!\\^%$@&"
_SCRAMBLE = "{}|`^~§¬!;.,':l1"
_KEYS = ("asdf", "qwer", "zxcv", "jkl;", "1234", ";;;", "ㅁㄴㅇㄹ", "ㅂㅈㄷㄱ")

Samples = dict[tuple[str, str, str], list[str]]  # (structure, language or script, form) -> lines


def content_words(lang: str) -> list[str]:
    """Words of a language's seed that are no function words."""
    text = SEED[lang]
    if lang in SPACELESS:
        return [w for w in re.findall("[一-鿿]{2,3}", "".join(" " if c in CHINESE else c for c in text))]
    words = [w.strip(".,").lower() for w in text.split()]
    if lang == "ko":
        return [w[:-1] for w in words if len(w) > 2]
    return [w for w in words if len(w) > 4 and not token_class(w)[0]]


class _Maker:
    def __init__(self, lang: str, rng: random.Random):
        self.lang, self.rng, self.content = lang, rng, content_words(lang)

    def words(self, least: int = 1, most: int = 2) -> str:
        return " ".join(self.rng.choices(self.content, k=self.rng.randint(least, most)))

    def number(self) -> str:
        rng = self.rng
        return rng.choice([f"{rng.random() * 100:.1f}", str(rng.randrange(1, 9000)), f"{rng.randrange(100)}%", f"20{rng.randrange(10, 30)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 28):02d}"])

    def code(self) -> str:
        rng = self.rng
        return rng.choice("OXYN") if rng.random() < 0.5 else "".join(rng.choices(string.ascii_uppercase, k=3)) + f"-{rng.randrange(100, 9999)}"

    def row(self, sep: str, kind: str) -> str:
        rng, n = self.rng, self.rng.randint(3, 6)
        if kind == "words":
            return sep.join(self.words(1, 1) for _ in range(n))
        if kind == "codes":
            return sep.join(self.number() if rng.random() < 0.2 else self.code() for _ in range(n))
        if kind == "sparse":
            return sep.join([self.words(), "" if rng.random() < 0.5 else self.code(), self.code()])
        return sep.join(rng.choice([self.number, self.number, self.code, self.words])() for _ in range(n))


def structural_samples(seed: int = 5, n: int = 60) -> Samples:
    """``n`` lines of each form of each structure; the same for the same seed."""
    rng = random.Random(seed)
    out: Samples = {}
    for lang, text in SEED.items():
        sentences = [s for s in re.split(r"(?<=[.。])\s*", text) if s]
        glue = "" if lang in SPACELESS else " "
        runs, parts = [], []
        for _ in range(n):
            at = rng.randrange(len(sentences))
            runs.append(glue.join(sentences[(at + j) % len(sentences)] for j in range(rng.randint(1, 4))))
            one = rng.choice(sentences)
            at = rng.randrange(max(1, len(one) - 30))
            parts.append(one[at : at + rng.randint(24, 60)])
        out["prose", lang, "run"], out["prose", lang, "part"] = runs, parts
        out["prose", lang, "paragraph"] = [glue.join(rng.choices(sentences, k=7)) for _ in range(n)]
        if glue:
            out["prose", lang, "gaps"] = ["".join(w + rng.choice(" ,\t,  ".split(",") + [" "]) for w in x.split()[:most]) for x in runs for most in (5, 99)]
    for lang in SEED:
        m = _Maker(lang, rng)
        script = "ideographs" if lang in SPACELESS else "letters"

        def add(structure: str, form: str, line) -> None:
            out.setdefault((structure, script, form), []).extend(line() for _ in range(n))

        add("list", "bare", m.words)
        add("list", "mark", lambda: rng.choice(["- ", "* ", "• ", "1. ", "(2) ", "3) ", "[x] ", "☐ "]) + m.words(1, 3) + rng.choice(["", "", "", "", ";", ",", "."]))
        add("list", "relation", lambda: m.words() + rng.choice([": ", " = ", " → ", " - ", "="]) + rng.choice([m.words, m.number])())
        add("list", "leader", lambda: f"{rng.randrange(1, 9)}.{rng.randrange(1, 9)} {m.words()} " + "." * rng.randint(4, 20) + f" {rng.randrange(1, 99)}")
        add("list", "inline", lambda: rng.choice(["; ", " #", " / ", " | ", " · "]).join(m.words() for _ in range(rng.randint(5, 40))))
        add("list", "commas", lambda: ", ".join(m.words() for _ in range(rng.randint(5, 40))))
        add("list", "path", lambda: "/" + "/".join(m.words(1, 1) for _ in range(rng.randint(2, 4))))
        for form, sep in (("pipe", " | "), ("tab", "\t"), ("gap", " " * 6), ("comma", ","), ("semicolon", ";"), ("dash", " -- ")):
            for kind in ("mixed", "words", "codes", "sparse"):
                add("table", f"{form} {kind}", lambda sep=sep, kind=kind: m.row(sep, kind))
        add("table", "html", lambda: "<tr>" + "".join(f"<td>{m.row('', 'codes')[:8]}</td>" for _ in range(4)) + "</tr>")
        few = [m.words() for _ in range(6)]
        add("junk", "few words", lambda: " ".join(rng.choice(few) for _ in range(rng.randint(25, 90))))
        out.setdefault(("junk", script, "one line"), []).extend(re.split(r"(?<=[.。])\s*", SEED[lang]))
        add("junk", "one entry", m.words)
        if lang in ("ko", "en", "de", "ja", "zh"):
            out["junk", lang, "scrambled"] = ["".join(rng.choice(_SCRAMBLE) if c != " " and rng.random() < 0.45 else c for c in x) for x in out["prose", lang, "run"]]
    english = content_words("en")
    symbols = lambda extra: "".join(rng.choice(_SYMBOLS + extra) if rng.random() < 0.85 else " " for _ in range(rng.randint(20, 90)))
    some = lambda line: [line() for _ in range(n)]
    out["table", "any", "ruler"] = some(lambda: rng.choice("-=") * 3 + rng.choice("|+").join("-" * rng.randint(2, 8) for _ in range(4)))
    out["junk", "any", "symbols"] = some(lambda: symbols(""))
    out["junk", "any", "symbols and letters"] = some(lambda: symbols("abcdefgh0123456789"))
    out["junk", "any", "lost"] = some(lambda: " ".join(rng.choice("?�") * rng.randint(2, 6) for _ in range(rng.randint(5, 20))))
    out["junk", "any", "half lost"] = some(lambda: " ".join(rng.choice(["??", "???", "???", rng.choice(english)]) for _ in range(rng.randint(5, 20))))
    out["junk", "any", "bytes"] = some(lambda: " ".join(f"{rng.randrange(256):02x}" for _ in range(rng.randint(12, 40))))
    out["junk", "any", "encoded"] = some(lambda: "".join(rng.choices(string.ascii_letters + string.digits + "+/", k=rng.randint(50, 200))))
    out["junk", "any", "letters"] = some(lambda: " ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 11))) for _ in range(rng.randint(15, 60))))
    out["junk", "any", "keys"] = some(lambda: "".join(rng.choices(_KEYS, k=rng.randint(5, 20))))
    return out
