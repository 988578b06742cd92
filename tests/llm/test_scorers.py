"""Classifiers and the language model: held-out accuracy and brute-force counts."""

from __future__ import annotations

import math
import random
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests_llm_helpers import prose
from tonegrain.llm import lm_score, quality, recurrent, toxicity
from tonegrain.llm.common import fold, ngram_hashes, word_hashes


def labelled(spark, mark, n=600):
    rng, docs, labels = random.Random(4), [], []
    for i in range(n):
        words, bad = prose(i, 60).split(), i % 6 == 0
        if bad:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), mark(rng))
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad), int(not bad)))
    return (
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
        spark.createDataFrame(labels, "doc_id long, toxic int, quality int"),
    )


def test_toxicity_finds_held_out_rows_and_is_sparse(spark):
    docs, labels = labelled(spark, lambda r: r.choice(["vile,", "FOUL", "nasty"]))
    model = toxicity.train(docs, labels, fold("_id", 5) != 0)
    assert 0 < model.index.size < 5000
    scored = docs.withColumn("p", toxicity.score(F.col("text"), model, docs)).filter(fold("doc_id", 5) == 0).collect()
    assert all((r["p"] >= 0.5) == (r["doc_id"] % 6 == 0) for r in scored)
    again = toxicity.train(docs.repartition(5), labels.repartition(2), fold("_id", 5) != 0)
    assert np.array_equal(again.weight, model.weight)


def test_quality_is_calibrated_and_counts_equal_brute_force(spark, awkward):
    docs, labels = labelled(spark, lambda r: "###$$$ | |")
    got = quality.apply(docs, quality.train(docs, labels)).collect()
    assert np.mean([r["kept"] == (r["doc_id"] % 6 != 0) for r in got]) > 0.97
    texts = {10: "a b c\na b c\n\nx #$ a b c", 11: "é ü x\n \n \n", 12: None, 13: "one two three " * 40}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in quality.apply(rows, None).collect():
        text = texts[r["doc_id"]] or ""
        words = text.encode().split()
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        hit = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if x.encode().split()]
        assert r["n_words"] == len(words) and r["n_repeat_words"] == len(hit)
        assert r["word_chars"] == sum(len(w.decode()) for w in words)
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_symbols"] == sum(text.count(c) for c in "#*$%&|<>")
        assert r["base_failed"] == (len(words) < 50 or 100 * len(hit) > 50 * len(words))
    assert quality.apply(awkward, None).count() == awkward.count()


def test_character_ngrams_are_of_code_points():
    kinds = quality.places("añ😀bcd".encode())
    assert [p.size for p in kinds] == [1, 0, 3, 2]
    same = quality.places("xñ😀bcd".encode())
    assert (kinds[2] == same[2]).tolist() == [False, True, True]


def test_scores_of_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 1), (5, 0, 0), (None, 1, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.train(awkward, labels)
    scores = awkward.select("doc_id", toxicity.score(F.col("text"), model, awkward).alias("p")).collect()
    assert all(0 <= r["p"] <= 1 for r in scores) and len(scores) == awkward.count()
    none = toxicity.train(empty, labels)
    assert not none.trained and awkward.select(toxicity.score(F.col("text"), none, awkward).alias("p")).distinct().collect()[0]["p"] == 0
    assert quality.apply(awkward, quality.train(awkward, labels)).count() == awkward.count()
    assert quality.apply(empty, None).count() == 0


def test_a_label_has_one_text_however_often_its_id_occurs(spark):
    docs = spark.createDataFrame([(i, f"text {i} {k % 3}") for i in range(50) for k in range(40)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] * 2, "doc_id long, toxic int")
    got = toxicity.labelled_sample(docs, labels, "toxic", F.lit(True), 20).collect()
    again = toxicity.labelled_sample(docs.repartition(5), labels, "toxic", F.lit(True), 20).collect()
    assert len(got) == 20 and sorted(got, key=lambda r: r["_id"]) == sorted(again, key=lambda r: r["_id"])
    assert all(bytes(r["_text"]).decode().split()[1] == str(r["_id"]) and r["_label"] == r["_id"] % 2 for r in got)


def in_fold(i, n):
    return zlib.crc32(str(i).encode()) % n == 0


def test_language_model_base_equals_brute_force_and_model_beats_it(spark, monkeypatch, awkward, empty):
    monkeypatch.setattr(lm_score, "KNOWN", 300)  # rarer words take the join
    monkeypatch.setattr(lm_score, "WORDS", 60)
    rng = random.Random(2)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{int(rng.random() ** 3 * 200)}" for _ in range(80)) + (f" odd{i}" if i % 3 else "")) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "Never seen WORDS")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = fold("doc_id", 10) == 0
    got = {r["doc_id"]: r for r in lm_score.score(docs, ~out, out).collect()}
    tokens = {i: (t or "").lower().split() + [""] for i, t in rows}
    count = Counter(w for i, t in tokens.items() if not in_fold(i, 10) for w in t)
    n, v = sum(count.values()), len(count)
    for i, own in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (in_fold(i, 10), len(own), sum(w in count for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own))
        assert r["score"] < 0
    held = [r for i, r in got.items() if r["held_out"] and i < 1000]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    out = fold("doc_id", 10) == 0
    assert lm_score.score(awkward, ~out, out).count() == awkward.count()
    assert lm_score.score(empty, ~out, out).count() == 0


def test_language_model_learns_from_every_row(spark):
    # 250,000 tokens in each of 4 tasks were the most that was learnt from.
    n = 1500
    docs = spark.createDataFrame([(i, f"w{i} " * 1000) for i in range(n)], "doc_id long, text string").repartition(4)
    known = lm_score.network_words(lm_score.frequent(lm_score.count_tokens(docs)))
    params, starts, _ = lm_score._train(docs, known, 0)
    before = recurrent.initial(np.append(known["c"].to_numpy(float), 0), starts)
    moved = (params["X"] != before["X"]).any(axis=1)
    assert len(known) == n + 1 and moved[:-1].all()


def test_network_gradients_and_probabilities():
    counts = np.array([50, 30, 20, 10, 5, 5, 5, 9.0])
    starts = np.array([0, 1, 3, 7, 8])
    p = recurrent.initial(counts, starts)
    h = np.random.default_rng(0).normal(0, 1, (1, recurrent.HIDDEN)).astype(np.float32)
    total = sum(math.exp(recurrent.log_probs(p, starts, h, np.array([t]))[0]) for t in range(8))
    assert total == pytest.approx(1, abs=1e-5)
    texts = [np.array([1, 2, 0]), np.array([3, 0]), np.array([0]), np.array([4, 4, 7, 1, 0])]
    side = recurrent.score_texts(p, starts, texts, end=0, group=2)
    alone = [recurrent.score_texts(p, starts, [t], end=0)[0] for t in texts]
    assert np.allclose(side, alone, atol=1e-4)
    # Learning a cycle drives its loss far below the unigram loss.
    learner = recurrent.Learner(p, starts, end=0)
    tokens = np.tile([1, 2, 3, 0], 3000)
    before = recurrent.score_texts(learner.p, starts, [np.array([1, 2, 3, 0])], 0)[0]
    learner.fit(tokens, epochs=3)
    assert recurrent.score_texts(learner.p, starts, [np.array([1, 2, 3, 0])], 0)[0] > before / 3


def test_a_window_takes_few_calls_and_moves_along_the_gradient(monkeypatch):
    rng = np.random.default_rng(1)
    counts = np.append(rng.integers(1, 50, 3000), 9.0)
    starts = recurrent.class_starts(counts)
    p = {k: v.astype(float) for k, v in recurrent.initial(counts, starts).items()}
    ids, targets = rng.integers(0, 3001, (2, 3, 40))
    ids[1, :5] = 7  # some texts end within the window

    def loss(p):
        h, total = np.zeros((40, recurrent.HIDDEN)), 0.0
        for own, goal in zip(ids, targets):
            h = h * (own != 7)[:, None]
            x, u = p["X"][own], h @ p["U"]
            z, r = (1 / (1 + np.exp(-(x + u)[:, k * 32 : k * 32 + 32])) for k in (0, 1))
            h = (1 - z) * np.tanh(x[:, 64:] + r * u[:, 64:]) + z * h
            total -= recurrent.log_probs(p, starts, h, goal).sum(dtype=float)
        return total / 40

    calls, moves, exp = [], {}, np.exp
    learner = recurrent.Learner({k: v.astype(np.float32) for k, v in p.items()}, starts, end=7)
    with monkeypatch.context() as patch:
        patch.setattr(np, "exp", lambda *a, **k: calls.append(1) or exp(*a, **k))
        patch.setattr(learner, "_move", lambda value, g2, grad, at=None: moves.setdefault(value.shape, (grad.copy(), at)))
        learner.window(np.zeros((recurrent.HIDDEN, 40), np.float32), ids, targets)
    # One for the gates of each step, one for the classes, one for the words of all classes, which were one each.
    assert len(calls) == 5 and len(starts) > 40
    words = moves[3001, 33][0]
    found = {"U": moves[32, 96][0], "Wc": moves[p["Wc"].shape][0], "bc": moves[p["bc"].shape][0], "Ww": words[:, :32], "bw": words[:, 32]}
    found["X"] = np.zeros_like(p["X"])
    found["X"][moves[3001, 96][1]] = moves[3001, 96][0]
    for name, grad in found.items():
        way = grad / np.linalg.norm(grad) + rng.normal(0, 0.3 / grad.size**0.5, grad.shape)
        sides = [loss(p | {name: p[name] + step * way}) for step in (1e-4, -1e-4)]
        assert (grad * way).sum() == pytest.approx((sides[0] - sides[1]) / 2e-4, rel=1e-3), name


def test_sums_of_frequent_and_rare_keys():
    rng = np.random.default_rng(3)
    keys = np.concatenate([np.zeros(50, int), np.ones(9, int), rng.integers(2, 60, 100)])
    rows = rng.normal(0, 1, (keys.size, 5))
    own, sums = recurrent._sums(rows, keys)
    assert own.tolist() == sorted(set(keys.tolist()))
    assert np.allclose(sums, [rows[keys == k].sum(axis=0) for k in own])


def test_texts_far_apart_in_length_and_extreme_weights_are_scored():
    counts = np.array([50, 30, 20, 10, 5, 5, 5, 9.0])
    starts = np.array([0, 1, 3, 7, 8])
    p = recurrent.initial(counts, starts)
    p["bw"][3] = 200.0  # far beyond what single precision can exponentiate
    texts = [np.array([3, 4, 0] * n, np.uint16) for n in (1, 700, 2)]
    got = recurrent.score_texts(p, starts, texts, end=0)
    alone = [recurrent.score_texts(p, starts, [t], end=0)[0] for t in texts]
    assert np.isfinite(got).all() and np.allclose(got, alone, rtol=1e-5)
    learner = recurrent.Learner(p, starts, end=0)
    learner.fit(np.tile([3, 4, 0], 200))
    assert all(np.isfinite(v).all() for v in learner.p.values())


def test_word_hashes_depend_on_words_only():
    a, b = word_hashes(b"one  two\tthree one"), word_hashes(b"\x0cone\ntwo three\x0b one ")
    assert np.array_equal(a, b) and a[0] == a[3] and len(set(a.tolist())) == 3
    assert word_hashes(b" \n").size == 0 and ngram_hashes(a, 5).size == 0
    assert word_hashes(("é" * 70_000).encode()).size == 1


def test_words_are_counted_with_few_calls_for_a_batch():
    rng = random.Random(6)
    texts = [b"", b" ", b"A", b"\n a", b"a \t", bytes(range(256)), "É naïve 😀 x\x1cY\x85z".encode(), b"\xff\xfe A\x00B"]
    texts += [bytes(rng.choice(b" \t\n\x0b\x0c\rabAZ\x1c\x1f\x85\xa0\x00\xe9") for _ in range(rng.randrange(40))) for _ in range(3000)]
    want = [[*t.lower().split(), b""] for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["text"])
    calls = 0

    def called(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(called)
    try:
        counted = list(lm_score._count(iter([batch])))
    finally:
        sys.setprofile(None)
    assert calls < len(texts)  # each text was split by some calls of its own
    counts = Counter()
    for part in counted:
        counts.update(dict(zip(part["word"].to_pylist(), part["c"].to_pylist(), strict=True)))
    assert counts == Counter(w for own in want for w in own)
    for start in (0, 5):  # a slice of a batch knows its own texts
        assert lm_score.words_of(batch["text"].slice(start)).cast(pa.list_(pa.binary())).to_pylist() == want[start:]


def test_texts_are_dealt_in_pieces_and_none_is_left_out(monkeypatch):
    monkeypatch.setattr(lm_score, "PIECE_BYTES", 10)
    texts = [b"", b"a" * 25, b"bc", b"d" * 8, b"e", b"", b"f" * 10, b""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts, pa.binary())], names=["row", "text"])
    pieces = list(lm_score._pieces(iter([batch, batch.slice(0, 0), batch.slice(3)])))
    assert [r for p in pieces for r in p["row"].to_pylist()] == [*range(8), *range(3, 8)]
    assert all(p.num_rows == 1 or sum(map(len, p["text"].to_pylist())) <= 10 for p in pieces) and len(pieces) < 10
