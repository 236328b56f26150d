"""Problem 8: kinds of texts and their statistics."""

import random
import re
import string

import numpy as np

from lexloom.llm import quality, structures

PROSE = ["The server was restarted by the operator, and the log shows who did it. There was no reason to wait until the problem had been solved.", "관리자는 로그 파일을 먼저 확인하고 서버를 다시 시작했습니다. 오류가 발생하면 담당자에게 알려 주십시오.", "Der Bericht wurde von dem Leiter geprüft und danach an die Kollegen verschickt", "管理员已经检查了日志文件，但是还没有通知用户。", "この文書では、設定の方法を説明します。まずログを確認してください。", "the report was sent   to the office and\tthen it was   read by all of them", "Short note to the team."]
LISTS = ["1. retention policy;\n2. missing index;\n3. test bench;\n4. mailbox;", "- 서버\n- 색인\n- 로그파일 교체\n- 대시보드", "1.1 schema ........ 3\n1.2 parser ............ 5\n1.3 index ........ 7\n2.1 queue ..... 9", "server=on\nmode: fast\npath=/srv/a/b\nlimit: 5", "[x] server\n[ ] queue\n[x] index\n[ ] mailbox", "/srv/a/run.pid\n/srv/b/data/pack\nD:\\X\\store_1", "recado\n\ncontrato\n\nprocesso\n\nusuário\n\nserviço", "체크섬; 인증서; 리스너; 방화벽; 감사기록 검토; 저장계층; 상담창구", "parser #archive #runbook #work order #backup #mailbox #console"]
TABLES = ["| a | b | c |\n| --- | --- | --- |\n| 1.5 | 2.5 | x |\n| 3.5 | 4.5 | y |", "name\tsize\tdate\nserver\t12\t2025-01-01\nqueue\t7\t2025-01-02", "<table><tr><td>a</td><td>b</td></tr>\n<tr><td>1</td><td>2</td></tr></table>", "server           queue            state\n12.5             7.25             Y\n1.25             9.75             N", "a,b,c,d\n1,2,3,4\n5,6,7,8", "server -- queue -- index\n52.7 -- 69.2 -- 55.4\n84.4 -- 25.2 -- 23.3"]
JUNK = ["?? ???? ??? ????? ?? ??. ???? ??? ???", "#::~/>_|/~.#*:+#=+-___ >::\n*:>|\\#\\|=|<#:#>|~_<+<\n=: >+/ .//\\*#>*_-", "49 bd d8 c3 90 30 8d c6 a7 de 73 27 dd 64 a4 65 ad 92 02 d3 19 a3 ff 54 c5 c4", "asdfqwerㅁㄴㅇㄹ1234zxcvㅁㄴㅇㄹasdf;;;jkl;qwerㅁㄴㅇㄹ", "adapter schema adapter adapter " * 20, "Still, the certificate was moved by mistake.\n" * 9]


def kind(text):
    return quality.describe(text)["kind"]


def test_kinds():
    for want, texts in (("prose", PROSE), ("list", LISTS), ("table", TABLES), ("junk", JUNK)):
        for text in texts:
            assert kind(text) == want, (want, text)
    rng = random.Random(2)
    letters = " ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randrange(2, 12))) for _ in range(120))
    encoded = "".join(rng.choices(string.ascii_letters + string.digits + "+/", k=900))
    assert kind(letters) == "junk" and kind(encoded) == "junk"


def test_most_of_the_text_decides():
    assert kind("\n".join([PROSE[0]] * 1 + [PROSE[2]] + ["- server", "- queue"])) == "prose"
    assert kind("The log shows it\n" + "\n".join(f"- item {w}" for w in "server queue index mailbox schema parser".split())) == "list"


def test_divergence():
    assert quality.divergence((1, 0), (1, 0)) == 0 and quality.divergence((1, 0), (0, 1)) == 1 and quality.divergence((0, 0), (1, 0)) == 1
    assert quality.divergence((3, 1), (1, 3)) == quality.divergence((1, 3), (3, 1))


def test_statistics():
    got = quality.describe("The server was here.\nno end")
    assert got["n_words"] == 6 and abs(got["mean_word_len"] - 22 / 6) < 1e-9 and abs(got["symbol_share"] - 1 / 22) < 1e-9 and got["punct_line_share"] == 0.5 and got["common_share"] == 0.5


def test_table(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, PROSE[0]), (4, PROSE[0]), (5, LISTS[0]), (None, JUNK[0]), (6, (PROSE[0] + "\n" + PROSE[1] + " ") * 5000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, kind string, n_words int")
    out = quality.document_quality(df)
    got = sorted((r.doc_id or 0, r.kind or "", r.n_words) for r in out.collect())
    assert len(got) == len(rows) and [k for _, k, _ in got] == ["junk", "", "", "", "prose", "prose", "list", got[-1][1]]
    assert [n for i, _, n in got if i in (1, 2, 3)] == [0, 0, 0]
    assert quality.document_quality(df.limit(0)).count() == 0


def test_divergences_of_many_are_those_of_each():
    rng = np.random.default_rng(3)
    counts, profiles = rng.random((20, 5)) * (rng.random((20, 5)) < 0.7) + 1e-9, rng.random((4, 5))
    got = quality.divergences(counts, profiles / profiles.sum(axis=1, keepdims=True))
    for row, c in zip(got, counts):
        assert np.allclose(row, [quality.divergence(tuple(c), tuple(p)) for p in profiles])


def test_held_out_texts_of_each_form():
    samples = structures.structural_samples(seed=99, n=12)
    right = total = 0
    for (structure, _, form), lines in samples.items():
        if form in ("ruler", "part", "gaps", "leader") or form.startswith("one "):
            continue
        for at in range(0, 12, 6):
            total += 1
            right += kind("\n".join(lines[at : at + 6])) == structure
    assert right >= 0.97 * total, (right, total)


def test_profiles_decide():
    texts = PROSE + LISTS + TABLES + JUNK
    flat, swapped = quality.Profiles(), quality.Profiles()
    flat.table = np.full_like(flat.table, 1 / len(quality.CLASSES))
    swapped.of = (swapped.of[2], swapped.of[0], swapped.of[3], swapped.of[1])
    real = [d["kind"] for d in quality.describe_all(texts, quality.default_profiles())]
    for other in (flat, swapped):
        kinds = [d["kind"] for d in quality.describe_all(texts, other)]
        assert sum(a == b for a, b in zip(real, kinds)) <= 0.5 * len(texts)


def test_repeats_lists_and_scrambled_texts():
    assert kind("파서 색인 파서 색인 색인 파서 " * 12) == "junk" and kind("连接池 通知 通知 连接池 索引 通知 " * 12) == "junk"
    assert kind("썸네일\n" * 30) == "junk" and kind("索引, 台账, 队列, 证书, 连接池, 通知, 附件, 清单") == "list"
    assert kind("service\tqueue\tcontract\nKB-32096\tVH-40238\tY\nEZK-11404\tLS-52066\tY\nEDS-23360\tVLA-22792\t") == "table"
    assert kind("이 절}서; ,부파일: !떻, 복사}었. ~서가 무엇. '았는지 설명^니,. 아무¬ 에이전트, ^l. 것l§ 예!;지 못¬,}") == "junk"


def test_empty_and_odd_texts():
    for text in (None, "", " \n\t", "<b></b>"):
        assert quality.describe(text)["kind"] is None
    assert kind("￿" * 50) is not None and kind("a" * 200_000) == "junk"
    assert quality.describe_all([], quality.default_profiles()) == []


def test_plain_lines_need_no_pattern_of_separators(monkeypatch):
    class Refused:
        def subn(self, *_):
            raise AssertionError("searched")

    lines = ["The log, the index, and the queue were read (twice).", "관리자는 로그를 확인하고, 서버를 다시 시작했습니다.", "- the server-side queue was moved"]
    want = [quality.line_counts(x) for x in lines]
    monkeypatch.setattr(quality, "_SEPARATOR", Refused())
    assert [quality.line_counts(x) for x in lines] == want and all(v[quality.SEPARATOR] == 0 for v, _, _ in want)


def test_only_classes_of_a_row_take_logarithms(monkeypatch):
    taken, log2 = [0], np.log2
    counts, profiles = np.eye(14)[[0, 3] * 50] + np.eye(14)[13], np.full((40, 14), 1 / 14)
    monkeypatch.setattr(np, "log2", lambda x: (taken.__setitem__(0, taken[0] + np.size(x)), log2(x))[1])
    quality.divergences(counts, profiles)
    assert taken[0] < counts.size * len(profiles) / 4


def test_quick_ways_give_what_the_patterns_give():
    plain = {
        "_SEPARATOR": r"[|│\t]|;(?!\s*$)|(?<=\S)\s{2,}(?=\S)|,(?=\S)|\s--(?=\s)|</?t[rdh][ >/]|\s[/›»·•#](?=\s|\w)",
        "_RELATION": r"[=→⇒]|->|=>|:(?=\s)|\s[-–—](?=\s)|\.{4,}|…{2,}",
        "_INLINE_MARK": r"\*\*|(?<=\w)\[\d{1,3}\]|&[a-z]{2,6};",
    }
    rng = random.Random(4)
    parts = [*"aB1.,;:|│\t-–—=→⇒>…·•›»/#<?&*[] \xa0", "  ", " - ", " -- ", "->", "<td>", "</tr ", "[1]", "&amp;", "漢", "가", "。", "，", "the", "İ", "😀", "½"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randrange(1, 25)))
        for name, pattern in plain.items():
            bare, n = re.subn(pattern, " ", text)
            got, m = getattr(quality, name).subn(" ", text)
            assert (got.split(), m) == (bare.split(), n), (name, text)
        body = " ".join(text.split())
        assert quality._apart(body) or not re.search(plain["_SEPARATOR"], body), body
        joined = "".join(text.split())
        assert quality._symbols(joined) == sum(not c.isalnum() for c in joined)


def test_words_that_come_again():
    rng = random.Random(6)
    for _ in range(300):
        tokens = rng.choices(["the", "of", "index", "AB-12", "12", "queue", "--", "a"], k=rng.randrange(1, 30))
        want, seen, before = {}, set(), ""
        for token in tokens:
            unit = quality._unit(token)
            if (before, token) in seen or (token in seen and unit.kind in (quality.WORD, quality.CODE) and not unit.langs):
                want[unit] = want.get(unit, 0) + 1
            seen |= {token, (before, token)}
            before = token
        assert quality._come_again(tokens) == (want, sum(want.values()))


def test_kept_tokens_are_bounded():
    units = quality._Units()
    units.most = 10
    assert [units[f"w{i}"].kind for i in range(35)] == [quality.CODE] * 35 and len(units) <= 10
    line = " ".join("#" * n for n in [*range(1, 5000), 70, 70, 4999])  # more lengths than are likely, some of them twice
    assert quality.line_counts(line)[0][quality.SYMBOL] > 4e6 and "#" * 70 not in quality._UNITS
