"""Problem 4: PPM code lengths against a plain implementation, held-out accuracy, and whole tables."""

import math
from collections import Counter, defaultdict

import pytest

from lexloom.llm import langdata, language

HELD_OUT = {
    "ko": "관리자는 내일 아침까지 보고서를 제출해야 합니다.",
    "en": "The manager has to hand in the report by tomorrow morning.",
    "ja": "管理者は明日の朝までに報告書を提出しなければなりません。",
    "zh": "管理员必须在明天早上之前提交报告，但是文件还没有准备好。",
    "de": "Der Leiter muss den Bericht bis morgen früh abgeben.",
    "fr": "Le responsable doit remettre le rapport avant demain matin.",
    "es": "El responsable tiene que entregar el informe antes de mañana por la mañana.",
    "pt": "O responsável precisa entregar o relatório até amanhã de manhã.",
}


@pytest.fixture(scope="module")
def model():
    return language.PPM({lang: [text] for lang, text in langdata.SEED.items()})


def test_code_lengths_are_ppm():
    lines = {"a": ["abab abba", "bab"], "b": ["xyxx abxy"]}
    ppm = language.PPM(lines)
    probe = "abx yab"
    got, size = ppm.score([probe])
    assert size[0] == len(probe)
    for k, lang in enumerate(ppm.langs):
        counts = defaultdict(Counter)
        for line in lines[lang]:
            data = b"\n" * language.ORDER + line.encode()
            for i in range(language.ORDER, len(data)):
                for o in range(language.ORDER + 1):
                    counts[data[i - o : i]][data[i]] += 1
        data, bits = b"\n" * language.ORDER + probe.encode(), 0.0
        for i in range(language.ORDER, len(data)):
            for o in range(language.ORDER, -1, -1):
                c = counts.get(data[i - o : i])
                if c is None:
                    continue
                total, distinct = sum(c.values()), len(c)
                if data[i] in c:
                    bits -= math.log2(c[data[i]] / (total + distinct))
                    break
                bits -= math.log2(distinct / (total + distinct))
            else:
                bits += 8
        assert abs(got[0][k] - bits) < 1e-3


def test_held_out_sentences(model):
    for (lang, text), (got, conf, _, _) in zip(HELD_OUT.items(), language.judge_lines(model, list(HELD_OUT.values()))):
        assert got == lang and conf > 0.9, text


def test_lines_are_scored_alone(model):
    texts = list(HELD_OUT.values())
    together, _ = model.score([langdata.plain(t) for t in texts])
    for i, t in enumerate(texts):
        assert abs(model.score([langdata.plain(t)])[0][0] - together[i]).max() < 0.01


def test_nothing_natural(model):
    for text in ["", "   ", "0x2b45 0372", "[-20925] /a/b/c =18", "-- -- --", "123 456"]:
        assert language.judge_lines(model, [text])[0][0] == "und", text


def test_labels(spark):
    labels = ["ko_KR", "Korean", "한국어", " EN ", "en-GB", "German", "de-AT", "pt-BR", "zh-CN", "jpn", "", " ", None, "N/A", "unknown", "und", "Italian"]
    df = spark.createDataFrame([(x,) for x in labels], "l string")
    got = [r[0] for r in df.select(langdata.label_language(df.l)).collect()]
    assert got == ["ko", "ko", "ko", "en", "en", "de", "de", "pt", "zh", "ja", "", "", "", "", "", "", "italian"]


def test_table(spark, model):
    mixed = HELD_OUT["ko"] + "\r\n\n" + HELD_OUT["de"] + "\n" + (HELD_OUT["ko"] + " ") * 3 + "\n#단어"
    rows = [
        ("right", HELD_OUT["en"], None, "en-US", 1),
        ("wrong", HELD_OUT["en"], "x", "ko", 1),
        ("wrong", HELD_OUT["en"], "x", "ko", 1),
        ("missing", HELD_OUT["ja"], None, None, 1),
        ("title", "  ", HELD_OUT["fr"], "", 1),
        ("mixed", mixed, None, "ko", 1),
        ("codes", "0x11 0x22", None, "auto", 1),
        ("empty", None, None, "en", None),
        ("odd", HELD_OUT["en"] + "\n#색인승인", None, "en", 1),
        ("name", "Bikromrul의 경우 관리자는 /srv/a.xml 파일을 먼저 확인해야 합니다.\n" + HELD_OUT["ko"], None, "ko", 1),
        (None, "x", None, None, 1),
        ("long", (HELD_OUT["en"] + " ") * 20_000, None, "de", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id string, text string, title string, lang_label string, ingested_at int")
    got = sorted((r.doc_id, r.line_no, r.lang) for r in language.detect_languages(df, model).collect())
    assert got == [("codes", -1, "und"), ("empty", -1, "und"), ("long", -1, "en"), ("missing", -1, "ja"), ("mixed", 0, "ko"), ("mixed", 2, "de"), ("mixed", 3, "ko"), ("mixed", 4, "ko"), ("title", -1, "fr"), ("wrong", -1, "en")]
    assert language.detect_languages(df.limit(0), model).count() == 0
    assert language.fit_ppm(df.limit(0)).score(["abc"])[0].shape == (1, 8)


def test_all_lines_are_fitted():
    lines = ["".join(chr(97 + i // 26 ** k % 26) for k in range(4)) + " word" for i in range(20_000)]
    known = language.PPM({"en": [*lines, "öüö"], "de": ["öä"]}).score(["öüö"])[0][0, 0]
    assert sum(map(len, lines)) > 160_000 and known < language.PPM({"en": lines, "de": ["öä"]}).score(["öüö"])[0][0, 0]
