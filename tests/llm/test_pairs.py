"""Problem 5: verdicts on pairs of each kind, sound ones, and whole tables."""

import time

import pytest

from lexloom.llm import langdata, pairs

CASES = [
    ("How do I start it?", None, "empty"),
    ("How do I start it?", " \n", "empty"),
    ("How do I start it?", "​", "empty"),
    ("How do I start it?", "N/A", "empty"),
    ("How do I start it?", "답변:", "empty"),
    ("How do I start it?", "<p></p>", "empty"),
    ("How do I start it?", "Sorry, I can't help with this topic.", "refusal"),
    ("How do I start it?", "I'm afraid we don't provide guidance on that request.", "refusal"),
    ("서버를 어떻게 시작하나요?", "죄송하지만 요청하신 내용은 검색 결과가 없습니다. 다시 질문해 주시겠어요?", "refusal"),
    ("서버를 어떻게 시작하나요?", "Unfortunately, my access does not cover that request.", "refusal"),
    ("How often should the server be restarted?", '"How often should the server be restarted?"', "copy"),
    ("How often should the server be restarted?", "How often should the server be restarted? How often should the server be restarted?", "copy"),
    ("서버를 어떻게 시작하나요?", "서버를 어떻게 시작하나요 라고 문의하셨습니다.", "copy"),
    ("서버를 어떻게 시작하나요?", "First check the log file and then tell the administrator about the error.", "other_language"),
    ("How often should the server be restarted?", "먼저 로그 파일을 확인한 다음 관리자에게 알려 주십시오.", "other_language"),
    ("How often should the server be restarted?", "Der Bericht muss bis morgen früh fertig sein, und zwar in der Besprechung.", "other_language"),
    ("서버를 어떻게 시작하나요?", "로그 파일을 먼저 확인하십시오. 오류가 발생하면 관리자에게", "truncated"),
    ("How do I start it?", "First check the log file. Then tell the", "truncated"),
    ("How do I start it?", "Use this configuration:\n```\na.limit=5\na.mode=", "truncated"),
    ("How do I start it?", "There are three things to check.\n1. The log file has been written by the system\n2.", "truncated"),
    ("How do I start it?", "First check the log file and then…", "truncated"),
    ("How do I start it?", "First check the log file and then tell the administrator.", None),
    ("How do I start it?", "Port 88.", None),
    ("How do I start it?", "/srv/a/conf/main.xml", None),
    ("How do I start it?", "systemctl restart server", None),
    ("How do I start it?", "Checklist\n1) restored index\n2) scanned server", None),
    ("서버를 어떻게 시작하나요?", "재기동 불필요", None),
    ("서버를 어떻게 시작하나요?", "네, 필요합니다.", None),
    ("서버를 어떻게 시작하나요?", "Dungnumrom에 '검색 결과가 없습니다'가 표시되면 서버를 재기동하면 됩니다.", None),
    ("서버를 어떻게 시작하나요? 영어로 답해줘", "First check the log file and then tell the administrator about it.", None),
    ("How do I start it?", ("First check the log file and then tell the administrator. " * 9)[:200] + " ...", None),
    (None, "First check the log file and then tell the administrator.", None),
    ("", "First check the", "truncated"),
]


@pytest.fixture(scope="module")
def judge():
    lines = {lang: [s if s.endswith(("。", ".")) else s + "." for s in text.split(". ")] * 3 for lang, text in langdata.SEED.items()}
    return pairs.PairJudge(lines)


def test_verdicts(judge):
    wrong = [(q, a, want, got) for q, a, want in CASES if (got := judge.verdict(q, a)) != want and want != "truncated"]
    assert not wrong
    cut = [(a, got) for q, a, want in CASES if want == "truncated" and (got := judge.verdict(q, a)) != want]
    assert len(cut) <= 1, cut


def test_posteriors(judge):
    for lang, text in langdata.SEED.items():
        post, letters = judge.languages.posteriors(text[:60])
        assert max(post, key=post.get) == lang and letters > 10
    assert judge.languages.posteriors("") == ({}, 0) or judge.languages.posteriors("")[1] == 0


def test_table(spark, judge):
    rows = [(i, q, a, None) for i, (q, a, _) in enumerate(CASES)] * 2 + [(None, "q", None, 1), (500, "q?", "old", 1), (500, "How do I start it?", None, 2), (501, "x" * 9000, "y. " * 100_000, 1)]
    df = spark.createDataFrame(rows, "entry_id bigint, question string, portal_answer_snippet string, logged_at int")
    got = [(r.entry_id, r.defect) for r in pairs.broken_pairs(df, judge).collect()]
    assert len(got) == len(dict(got)) and dict(got)[500] == "empty"
    assert {i: d for i, d in got if i < 400} == {i: d for i, (q, a, _) in enumerate(CASES) if (d := judge.verdict(q, a))}
    assert pairs.broken_pairs(df.limit(0), judge).count() == 0


def test_all_lines_are_fitted():
    model = pairs.NgramBayes({"en": ["some words"] * 15_000 + ["öüö"]})
    assert len("some words") * 15_000 > 120_000 and "öüö" in model.index


HELD_OUT = {
    "en": "The operator restarted the server because the disk was full and nobody had noticed it. We will look at the report again when the numbers of the last week are there.",
    "ko": "디스크가 가득 차서 관리자가 서버를 다시 시작했습니다. 지난주 수치가 나오면 보고서를 다시 살펴보겠습니다.",
    "de": "Der Verwalter hat den Rechner neu gestartet, weil die Platte voll war und niemand es bemerkt hatte.",
}


def test_end_likelihood_decides(judge, monkeypatch):
    whole = [s if s.endswith(".") else s + "." for text in HELD_OUT.values() for s in text.split(". ")]
    cut = [" ".join(s.split()[:k]) for s in whole for k in (5, 6, 7) if len(s.split()) > k]
    assert not any(judge.verdict(None, s) for s in whole)
    assert sum(judge.verdict(None, s) == "truncated" for s in cut) >= 0.9 * len(cut)
    for constant in (-9.0, 9.0):
        monkeypatch.setattr(judge.ends, "log_odds", lambda *_, c=constant: c)
        verdicts = [judge.verdict(None, s) for s in whole + cut]
        assert sum(v == "truncated" for v in verdicts) in (0, len(whole) + len(cut))


def test_bound_is_fitted_on_held_out_sentences(judge):
    assert judge.ends.held_out_errors <= 0.1
    model = pairs.EndModel
    assert model._fit_bound([]) == (0.0, 0.0)
    bound, errors = model._fit_bound([(False, -3.0), (False, -1.0), (True, 1.0), (True, 1.2), (True, 2.0), (False, 1.5)])
    assert -1 < bound < 1 and errors == 1 / 6


def test_refusal_after_courtesies_and_far_brackets(judge):
    assert judge.verdict("How do I start it?", "Hello. Thank you. Good question. Let me see. I cannot help with this.") == "refusal"
    assert judge.verdict("How do I start it?", "I cannot help with this.") == "refusal"
    assert judge.verdict("How do I start it?", "Use the console (" + "the log is written there and the rest is checked, " * 8 + "then stop") == "truncated"


def test_long_runs_of_letters_are_read_at_once():
    began = time.time()
    assert langdata.plain("a" * 1_000_000) == "a" * 1_000_000 and langdata.plain("x" * 500_000 + "1" + "y" * 500_000) == ""
    assert time.time() - began < 1
    assert langdata.plain("서버12abc /srv/a.log is down") == "서버 is down"


def test_sample_is_bounded_and_the_smallest_hashes(spark):
    text = "The log file is checked by the administrator and then the server is started again."
    df = spark.range(3000).selectExpr("cast(id as string) doc_id", "if(id % 3 = 0, 'de', 'en') lang_label", f"concat('{text} ', id) text")
    lines = langdata.training_lines(df, rows_per_language=20)
    hashes = df.where("lang_label = 'en'").selectExpr("xxhash64(doc_id) h", "text").orderBy("h").limit(20).collect()
    assert {r.text for r in hashes} == {x for x in lines["en"] if x.startswith(text)}
    assert langdata.training_lines(df.limit(0))["en"] == langdata.SEED["en"].split(". ")
