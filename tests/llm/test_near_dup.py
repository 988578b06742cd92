"""Near duplicates against brute force over all pairs."""

from __future__ import annotations

import random

import numpy as np

from tests_llm_helpers import components_by_force, line, prose
from tonegrain.llm import common, near_dup


def shingle_set(text):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def edited(text, seed, every):
    rng, words = random.Random(seed), text.split()
    for i in range(len(words)):
        if rng.random() < every:
            words[i] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def test_components_equal_brute_force(spark):
    rows, base = [], prose(0, 150, 10**6)
    # A large group of near copies of one text, at many distances, so that links chain.
    rows += [(i, edited(base, i, 0.002 + 0.0009 * (i % 40))) for i in range(240)]
    rows += [(1000 + i, prose(100 + i, 40 + i, 10**6)) for i in range(30)]
    rows += [(2000 + i, rows[5][1].upper()) for i in range(20)] + [(3000, ""), (3001, None), (3002, "a b"), (3003, "A  b"), (3004, "b a")]
    random.Random(3).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.find(docs).collect()}
    sets = {i: shingle_set(t) for i, t in rows}

    def link(a, b):
        both = len(sets[a] & sets[b])
        return both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both)

    want = components_by_force(list(sets), link)
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_awkward_rows(awkward, empty):
    got = near_dup.find(awkward).collect()
    assert len(got) == awkward.count()
    assert [r["first"] for r in got if r["doc_id"] == 1].count(True) == 1
    assert all(r["first"] for r in got if r["n_shingles"] == 0)
    kept = near_dup.keep_first(awkward)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() - 1
    assert near_dup.find(empty).count() == 0 and near_dup.keep_first(empty).count() == 0


def test_frequent_and_rare_keys_give_one_result(spark, monkeypatch):
    hot = prose(1, 60, 10**6)
    rows = [(None if i < 3 else i, hot) for i in range(80)] + [(100 + i, edited(hot, i, 0.004)) for i in range(60)]
    rows += [(200 + i, prose(300 + i // 2, 50, 10**6)) for i in range(40)] + [(300 + i, None) for i in range(30)] + [(None, "x y")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)

    def digest():
        got = near_dup.find(docs).collect()
        firsts = [r["component_id"] for r in got if r["first"] and r["n_shingles"]]
        assert len(firsts) == len(set(firsts)) and len(got) == len(rows)
        return sorted(((r["doc_id"] or -1), r["n_shingles"], r["component_id"] or -1) for r in got)

    whole = digest()  # all lines are broadcast
    assert all(c == 3 for i, n, c in whole if n and 2 < i < 80)
    for narrow in (0, 2, 40):  # none, the hot text's, some
        monkeypatch.setattr(common, "NARROW", narrow)
        assert digest() == whole


def test_min_and_max_estimate_similarity():
    rng = np.random.default_rng(1)
    own = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
    a, b = own[:1600], own[400:]  # similarity 0.6
    (la, ha), (lb, hb) = near_dup.min_max(a), near_dup.min_max(b)
    assert abs(np.mean(np.concatenate([la == lb, ha == hb])) - 0.6) < 0.15
    x = near_dup.signs(la, ha)
    assert x.size == 4 and line(1, "a")[0] == 1
