"""Problem 1: the automaton against plain edit distance, levelling, and whole tables."""

import random

from lexloom.llm import canonical

LIST = [
    (1, "Hongmaphu Scheduler", None),
    (2, "Kilsensa Scheduler", ["킬센사 스케줄러"]),
    (3, "Kilsensa Scheduler Lite", ["킬센사 스케줄러 라이트"]),
    (4, "밤돗레 식품", ["Bamdotre Foods"]),
    (5, "Bamdotre Textiles", None),
    (6, "Backup Manager", None),
    (7, "Lead Backup Manager", None),
    (8, "Hongkilsen Foods", ["홍킬센 식품"]),
    (9, "Maphudot Foods", ["맙후돗 식품"]),
]
TRIE = canonical.CanonicalTrie(LIST)


def test_search_is_edit_distance():
    rng = random.Random(1)
    keys = list(TRIE.exact)
    for _ in range(150):
        key = list(rng.choice(keys))
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(key))
            rng.choice([lambda: key.insert(i, "x"), lambda: key.pop(i), lambda: key.__setitem__(i, "q"), lambda: key.__setitem__(slice(i, i + 2), key[i : i + 2][::-1])])()
        key = "".join(key)
        want = {}
        for k, ids in TRIE.exact.items():
            d = canonical.edits(key, k)
            if d <= 2:
                for i in ids:
                    want[i] = min(d, want.get(i, 9))
        assert TRIE.search(key, 2) == want


def test_spellings():
    for text, want in {
        "Kilsensa Scheduler": 2,
        " kILSENSA_sCHEDULER;": 2,
        "Ｋｉｌｓｅｎｓａ Ｓｃｈｅｄｕｌｅｒ": 2,
        "Kil​sensa Scheduler v3": 2,
        "Scheduler, Kilsensa": 2,
        "킬센사 Scheduler": 2,
        "킬센사 스케줄러 라이트": 3,
        "Kilsensa Scheduler Lite 5.8.1": 3,
        "Kilsensa Schedulr": 2,
        "홍맙후 스케줄러": 1,
        "(주)밤돗레 식품": 4,
        "Bamdotre Foods Co., Ltd.": 4,
        "Bаmdotre Foods": 4,
        "bamdorte fods": 4,
        "Bamdotre Textiles (Korea)": 5,
        "Backup Mgr": 6,
        "Ld. Backup Manager": 7,
        "Backup Manager (acting)": 6,
    }.items():
        assert TRIE.meaning(text) == want, text


def test_other_wordings_are_other_items():
    for text in ["Hongmaphu Scheduler Lite", "Kilsensa Foods", "Bamdotre Scheduler", "Lead Backup", "Manager", "Dotmaphu Foods", "", "  ", "-", "n/a", "3.4.13", "ABC-1234", "x" * 5000]:
        assert TRIE.meaning(text) == 0, text


def test_candidates_give_all_within_distance():
    assert TRIE.candidates("Kilsensa Schedule")[0] == (2, 1)
    assert canonical.CanonicalTrie([]).candidates("abc") == []


def test_table(spark):
    rows = [
        ("e1", "product", "Kilsensa Schedulr", ["Backup Manager"], 1),
        ("e2", None, "server", ["x", None, "", "밤돗레 식품"], 1),
        ("e2", None, "server", ["x", None, "", "밤돗레 식품"], 1),
        ("e3", "OTHER", None, None, 1),
        ("e4", "role", "Backup Manager", [], 1),
        ("e4", "role", "Lead Backup Manager", [], 2),
        ("e5", "role", "nothing of the kind", [], None),
        (None, "role", "Backup Manager", [], 1),
    ]
    entities = spark.createDataFrame(rows, "entity_id string, entity_type string, name string, aliases array<string>, updated_at int")
    canon = spark.createDataFrame([(i, "t", n, a) for i, n, a in LIST] + [(None, "t", "z", None), (99, None, None, [None])], "canon_id bigint, entity_type string, canonical_name string, known_aliases array<string>")
    got = {r.entity_id: (r.canon_id, r.matched_by) for r in canonical.map_entities(entities, canon).collect()}
    assert got == {"e1": (2, "name"), "e2": (4, "alias"), "e3": (0, None), "e4": (7, "name"), "e5": (0, None)}
    assert canonical.map_entities(entities.limit(0), canon).count() == 0
    assert {r.canon_id for r in canonical.map_entities(entities, canon.limit(0)).collect()} == {0}


def test_padding_of_any_length_is_levelled():
    for typed in ("Backup Manager" + " " * 600 + "v2.1", "Backup" + "​" * 600 + " Manager"):
        assert TRIE.meaning(typed) == 6
    assert TRIE.meaning("Backup Manager" + " word" * 1000) == 0


def test_every_spelling_and_long_abbreviations():
    # twelve Hangul spellings of one head, as syllables that share a romanisation stand in other entries
    pairs = [("Kakda", "각다"), ("Kakra", "갂라"), ("Kakma", "갘마"), ("Dakma", "닥마"), ("Dakra", "닦라"), ("Dakba", "닼바"), ("Kakdak", None)]
    entries = [(i, f"{a} Broker", [f"{b} 브로커"] if b else None) for i, (a, b) in enumerate(pairs, 1)]
    trie = canonical.CanonicalTrie([(i, n.replace("Kak", "Gak"), a) for i, n, a in entries])
    spellings = list(trie._spellings("gakdak"))
    assert len(spellings) == 9 and len(set(spellings)) == 9 and all(trie.meaning(f"{w} 브로커") == 7 for w in spellings)
    assert canonical.CanonicalTrie([(1, "Incident Administrator", None), (2, "Incident Analyst", None)]).meaning("Incident Administr.") == 1


def test_search_below_a_word_is_the_search_among_its_entries():
    for word in ("scheduler", "foods", "kilsensa"):
        root = TRIE._root_for([word])
        for key in ("kilsensascheduler", "kilsensaschedulr", "hongkilsenfods", "bamdotrefood", "x"):
            assert TRIE.search(key, 2, root) == {i: e for i, e in TRIE.search(key, 2).items() if i in TRIE.having[word]}


def test_candidate_table(spark):
    entities = spark.createDataFrame([("e1", "Kilsensa Schedulr", ["Backup Manager", None]), ("e2", None, None), ("e3", "Backup Manager", []), ("e4", "", ["zzz"]), ("e5", "Kilsensa Schedulr", None)], "entity_id string, name string, aliases array<string>")
    canon = spark.createDataFrame([(i, n, a) for i, n, a in LIST], "canon_id bigint, canonical_name string, known_aliases array<string>")
    got = {(r.value, r.canon_id, r.distance) for r in canonical.candidate_entries(entities, canon).collect()}
    want = {(v, i, e) for v in ("Kilsensa Schedulr", "Backup Manager", "", "zzz") for i, e in TRIE.candidates(v) or [(None, None)]}
    assert got == want and ("Kilsensa Schedulr", 2, 1) in got and ("zzz", None, None) in got
    assert canonical.candidate_entries(entities.limit(0), canon).count() == 0


def test_search_from_both_ends_is_edit_distance():
    rng = random.Random(4)
    keys = list(TRIE.exact)
    for _ in range(120):
        key = list(rng.choice(keys))
        for _ in range(rng.randrange(5)):
            i = rng.randrange(len(key))
            rng.choice([lambda: key.insert(i, "x"), lambda: key.pop(i), lambda: key.__setitem__(i, "q"), lambda: key.__setitem__(slice(i, i + 2), key[i : i + 2][::-1])])()
        key = "".join(key)
        for most in (1, 2, 3):
            want = {}
            for k, ids in TRIE.exact.items():
                d = canonical.edits(key, k)
                if d <= most:
                    for i in ids:
                        want[i] = min(d, want.get(i, 9))
            assert TRIE.search(key, most) == want
    assert canonical.CanonicalTrie([(1, "x" * 3000, None)]).meaning("x" * 3000) == 1
