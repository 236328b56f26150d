"""Problem 7: leaks in changed appearance, near misses, chains and slots."""

import random

import numpy as np
import pytest

from lexloom.llm import leakage

ITEM = "Researchers at the Hakmoming laboratory reported that prolonged mowing explains 48 percent of the variation in seasonal mortality among grey carp near brackish clay banks. With a second buoy calibration, the survey ruled out irregular trampling, yet early foraging range still fell by a third wherever coastal moths reached windward peat blocks before day 114."
OTHER = "Researchers at the Belkokdip laboratory reported that sudden flooding explains 12 percent of the variation in lifetime growth among horned newts near volcanic gravel. With a pooled tissue assay, the survey ruled out faint lantern light, yet peak spore release still doubled wherever alpine ferns reached mossy daylight before day 9."
KOREAN = "칸달맙 연구회의 후속 조사에 따르면 불규칙한 곰팡이 감염이 끝나자마자 난쟁이 들쥐의 계절 효소 활성은 서서히 회복되었다고 하고, 그동안 걸러진 석회암은 21개월간 그대로였다."
NOTICE = "This document is for internal use only and must not be passed on to others without the consent of the issuing department."


def test_template_levels_appearance():
    a, b = [], []
    assert leakage.template("In Hitdekkan 12 days.", a).count(leakage.NUMBER) == 1
    plain = leakage.template_windows([ITEM])[0]
    changed = leakage.template_windows(["  ".join(ITEM.upper().split()).replace("HAKMOMING", "x").replace("48 PERCENT", "7 percent")])[0]
    assert len(np.intersect1d(plain, changed)) > 0.8 * len(plain)
    assert leakage.template("ａ​b", b) == "ab"


def test_chains():
    run = np.arange(0, 100)
    assert leakage.covered(leakage.chains(run, run + 500)) == 99 + leakage.WINDOW
    gapped = np.concatenate([np.arange(0, 40), np.arange(80, 120)])
    assert leakage.covered(leakage.chains(gapped, gapped + 7)) == 119 + leakage.WINDOW
    assert leakage.chains(np.array([0]), np.array([3])) == []


def test_slots():
    same = np.array([1, 1, 2, 2, 0])
    assert leakage.slots_agree(same, same) and leakage.slots_agree(same, np.array([5, 5, 6, 6, 0]))
    assert not leakage.slots_agree(np.ones(6, int), np.arange(6))
    assert leakage.slots_agree(np.zeros(3, int), np.zeros(3, int))


def test_table(spark):
    words = ITEM.split()
    half = " ".join(words[: len(words) * 2 // 3])
    edited = " ".join(w if i % 11 else "roughly" for i, w in enumerate(words))
    docs = [
        (1, "Before it. " + ITEM + " After it."),
        (2, ITEM.lower().replace(",", "").replace(".", "")),
        (3, "\n".join(ITEM[i : i + 37] for i in range(0, len(ITEM), 37))),
        (4, "Some words of another kind stand here first. " + half),
        (5, edited),
        (6, "Text on lichens. Researchers at the Simhitrin cohort reported that faint dredging explains 31 percent of the variation in peak fat content among striped gulls near frozen water. With a blinded recount, the survey ruled out early acid rain, yet relative root density still vanished wherever wild wasps reached salted ditches before day 77."),
        (7, "The survey ruled out many things. " + NOTICE),
        (8, None),
        (9, ""),
        (10, KOREAN.replace(" ", "")),
        (11, "긴 글. " * 50_000 + KOREAN + " 끝."),
        (1, "Before it. " + ITEM + " After it."),
    ]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in docs], "doc_id bigint, text string, hash int, pos int")
    items = spark.createDataFrame([(100, ITEM + " " + NOTICE), (101, OTHER + " " + NOTICE), (102, KOREAN), (103, None), (104, "")], "item_id bigint, item_text string")
    got = sorted((r.doc_id, r.item_id) for r in leakage.leaked_items(df, items).collect())
    assert got == [(1, 100), (2, 100), (3, 100), (4, 100), (5, 100), (10, 102), (11, 102)]
    for bits in (16, 20):  # beyond the bound of the broadcast: prefix filter and salted shuffle join
        shuffled = sorted((r.doc_id, r.item_id) for r in leakage.leaked_items(df, items, broadcast_most=0, filter_bits=bits).collect())
        assert shuffled == got
    assert leakage.leaked_items(df, items.limit(0), broadcast_most=0, filter_bits=16).count() == 0
    assert leakage.leaked_items(df.limit(0), items).count() == 0 and leakage.leaked_items(df, items.limit(0)).count() == 0


def test_notices_count_for_nothing(spark):
    assert leakage.notice_spans(np.arange(10, 80)) == [{"a": 10, "b": 79 + leakage.WINDOW}] and leakage.notice_spans(np.arange(0, 30)) == [] and leakage.notice_spans(np.array([], int)) == []
    bodies = [ITEM, OTHER, "Entirely other words make up this third passage, which nobody would take for one of the rest."]
    items = spark.createDataFrame([(i, b + " " + NOTICE) for i, b in enumerate(bodies)], "item_id bigint, item_text string")
    docs = spark.createDataFrame([(1, "Something else. " + NOTICE), (2, " ".join(ITEM.split()[:25]) + " and more. " + NOTICE)], "doc_id bigint, text string")
    assert [(r.doc_id, r.item_id) for r in leakage.leaked_items(docs, items).collect()] == [(2, 0)]


def test_a_growing_chain_stays_open_among_many():
    stray = [(2000 + 100 * k, 1001 + k % 38) for k in range(70)]  # matches of other places, each on a diagonal of its own
    grown = [(i, 1000 + i) for i in (*range(11), *range(40, 51))]
    i, d = (np.array(x) for x in zip(*grown, *stray))
    assert leakage.chains(i, d) == [(0, 70)]


def matches(item: str, text: str):
    h, _, pos, slots, size = leakage.template_windows([item])
    at: dict[int, list] = {}
    for x, p, a in zip(h.tolist(), pos.tolist(), slots.tolist()):
        at.setdefault(x, []).append((p, a))
    H, _, P, S, _ = leakage.template_windows([text])
    found = [(i, d, a, b) for x, d, b in zip(H.tolist(), P.tolist(), S.tolist()) for i, a in at.get(x, ())]
    return (*np.array(found, np.int64).reshape(-1, 4).T, int(size[0]))


def test_slots_agree_both_ways_and_by_kind():
    number, name = lambda k: 4 * k + 1, lambda k: 4 * k + 3
    array = lambda *x: np.array(x)
    four = [number(k) for k in (1, 2, 3, 4)]
    assert not leakage.slots_agree(array(*four), array(*[number(9)] * 4))  # different fillings that all became one
    assert not leakage.slots_agree(array(*[number(9)] * 4), array(*four))  # one filling, now so and now so
    assert not leakage.slots_agree(array(name(1), name(2), *[number(9)] * 4), array(name(5), name(6), *four))  # names don't hide it
    assert leakage.slots_agree(array(*four), array(*[number(k) for k in (7, 8, 9, 10)]))
    assert leakage.slots_agree(array(*[name(1)] * 3, name(2)), array(*[name(7)] * 3, name(8)))


CASE = "In the first trial {0} mice from {1} were fed for {2} weeks, then {0} mice from {1} rested while the {3} keepers at {1} wrote down every weight, and after {4} more days {0} mice had come back to the cages"


def test_kinds_of_slots():
    values: list[int] = []
    text = leakage.template("By then Hakmoming had 12 days. 한센딥 연구회의 조사는 30개월 걸렸다, 2 more", values)
    n, u, m = leakage.NUMBER, leakage.UNIT, leakage.NAME
    assert [c for c in text if c in n + u + m] == [m, n, u, m, n, u, n] and [v & 3 for v in values] == [3, 1, 2, 3, 1, 2, 1]


def test_slot_consistency_decides(monkeypatch):
    item = CASE.format(48, "Hakmoming", 6, 17, 9)
    same, other = CASE.format(48, "Hakmoming", 6, 17, 9), CASE.format(31, "Belkokdip", 8, 22, 5)
    mixed = other.replace("31", "33", 1).replace("31", "35", 1).replace("31", "37", 1)
    one = CASE.format(7, "Belkokdip", 7, 7, 7)
    share = lambda text: leakage.held_share(*matches(item, text))
    assert share(same) == 1 and share(other) == 1  # the same, and the same with other parameters throughout
    assert share(mixed) == 0 and share(one) == 0
    part = " ".join(other.split()[: len(other.split()) * 3 // 5])
    assert share(part) == 0 and share(part.replace("31", "48", 1)) > 0.5  # a part of the template alone is phrasing
    monkeypatch.setattr(leakage, "slots_agree", lambda a, b: True)
    assert share(mixed) > 0.9 and share(one) > 0.9


def test_windows_that_many_items_share(spark):
    family = [(i, CASE.format(i + 10, "Hakmoming", 6, 17, 9)) for i in range(12)]  # near copies: every window stands in more than eight items
    docs = spark.createDataFrame([(1, "Before. " + family[3][1] + " After."), (2, "Nothing of the kind stands in this text, which is about other things.")], "doc_id bigint, text string")
    items = spark.createDataFrame(family, "item_id bigint, item_text string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaked_items(docs, items).collect()}
    assert (1, 3) in got and {d for d, _ in got} == {1}
    copies = spark.createDataFrame([(i, ITEM) for i in range(5)], "item_id bigint, item_text string")
    found = leakage.leaked_items(spark.createDataFrame([(1, ITEM)], "doc_id bigint, text string"), copies)
    assert sorted(r.item_id for r in found.collect()) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("hangul", [False, True])
def test_bound_on_generated_cases(hangul):
    rng = random.Random(5)
    word = lambda: "".join(chr(0xAC00 + rng.randrange(11172)) if hangul else rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    vocabulary = [word() for _ in range(2000)]
    found = {0.28: 0, 0.5: 0}
    for part in found:
        for _ in range(60):
            words = rng.choices(vocabulary, k=rng.randint(40, 110))
            n = round(len(words) * part)
            at = rng.randrange(len(words) - n + 1)
            text = " ".join([*rng.choices(vocabulary, k=30), *words[at : at + n], *rng.choices(vocabulary, k=30)])
            found[part] += leakage.held_share(*matches(" ".join(words), text)) >= 0.37
    assert found[0.28] <= 1 and found[0.5] >= 59
