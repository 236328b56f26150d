"""Problem 3: containers, union, and frequencies against a plain count."""

import random
import re
from collections import Counter

import numpy as np

from lexloom.llm import frequency


def test_containers():
    for n in (0, 1, 5, 4096, 4097, 60_000):
        members = np.sort(np.random.default_rng(n).choice(frequency.BUCKET, n, replace=False))
        data = frequency.pack(members)
        assert frequency.unpack(data).tolist() == members.tolist() and frequency.cardinality(data) == n
        assert len(data) <= 8193
    a, b = frequency.pack(np.arange(0, 6000, 2)), frequency.pack(np.arange(0, 6000, 3))
    assert frequency.cardinality(frequency.union([a, b])) == len({*range(0, 6000, 2), *range(0, 6000, 3)})


def brute(rows):
    best = {}
    for doc, text, at in rows:
        if doc is not None and (doc not in best or (at, text or "") > (best[doc][0], best[doc][1] or "")):
            best[doc] = (at, text)
    occ, df = Counter(), Counter()
    for _, text in best.values():
        terms = [t for t in re.findall(r"[a-z0-9_]+|[가-힣]{2,}", (text or "").lower()) if len(t) > 1 and not t.isdigit()]
        occ.update(terms)
        df.update(set(terms))
    return {t: (occ[t], df[t]) for t in occ}, len(best)


def test_against_plain_count(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["한글", "a", "12", "X_1", "단"]
    rows = [(f"d{i}", None if i % 17 == 0 else "" if i % 13 == 0 else " ".join(rng.choices(words, k=rng.randrange(40))) + " common", i % 5) for i in range(300)]
    rows += rows[:40] + [("d1", "later text", 99), (None, "nothing", 1)]
    df = spark.createDataFrame(rows, "doc_id string, text string, at int").repartition(7)
    got = {r.term: (r.occurrences, r.df, r.corpus_docs, r.mark) for r in frequency.term_frequencies(df, order_col="at").collect()}
    want, n = brute(rows)
    assert {t: v[:2] for t, v in got.items()} == want and {v[2] for v in got.values()} == {n}
    for term, (_, d, _, mark) in got.items():
        assert mark == ("rare" if d <= 2 else "common" if d > 0.2 * n else None), term
    assert frequency.term_frequencies(df.limit(0)).count() == 0


def test_flushes_merge_by_union(spark):
    df = spark.createDataFrame([(f"d{i}", "alpha beta alpha") for i in range(50)], "doc_id string, text string").coalesce(1)
    small = frequency.term_containers(df, "doc_id", "text", flush_pairs=7)
    assert small.where("term = 'alpha'").count() > 5
    got = {r.term: (r.df, r.occurrences) for r in frequency.term_frequencies(df).collect()}
    assert got == {"alpha": (50, 100), "beta": (50, 50)}
