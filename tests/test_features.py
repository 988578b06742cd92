from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from rows import rows_of
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from tonegrain.functions.text import strip
from tonegrain.operators import classifier, features, linear
from tonegrain.schema import CLASSES
from tonegrain.sources.staging import stage

WORDS = "alpha beta gamma delta naïve straße été x1 c_d 市场 up down".split()


def corpus(n=60):
    rows = []
    for i in range(n):
        words = [WORDS[(i * k + k * k) % len(WORDS)] for k in range(1, 3 + i % 17)]
        rows.append((i, " ".join(words) + ". The the THE", CLASSES[i % 3]))
    return rows + [(n, "", "neutral"), (n + 1, "a b c", "neutral"), (n + 2, "the", "positive")]


SCHEMA = "row_id bigint, input_text string, class string"


def tokens(text):
    return re.findall(r"(?u)\b\w\w+\b", text.lower())


def grams(text, n_max):
    toks = tokens(text)
    return [" ".join(toks[i : i + n]) for n in range(1, n_max + 1) for i in range(len(toks) - n + 1)]


def test_tokens_match_python(make):
    texts = ["a bb c_d é éé x1", "", "single", "don't stop-now", "東京 2024 is_ok a", "_ __ _1", None]
    df = make([(i, t) for i, t in enumerate(texts)], "row_id bigint, input_text string")
    got = dict(rows_of(features.tokenize(df), "row_id", "tokens"))
    assert got[0] == ["bb", "c_d", "éé", "x1"]
    for i, t in enumerate(texts):
        assert got[i] == (None if t is None else tokens(t))


@pytest.mark.parametrize("n", [1, 2, 3])
def test_ngrams_match_python(make, n):
    rows = corpus()
    got = dict(rows_of(features.ngrams(make(rows, SCHEMA), n), "row_id", "terms"))
    for i, text, _ in rows:
        assert got[i] == grams(text, n)


def brute_tfidf(rows, n_max, min_df, max_df):
    counts = {i: Counter(grams(t, n_max)) for i, t, _ in rows}
    df = Counter(term for c in counts.values() for term in c)
    n = len(rows)
    vocab = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in df.items() if min_df <= d <= max_df * n}
    weights = {}
    for i, c in counts.items():
        raw = {t: k * vocab[t] for t, k in c.items() if t in vocab}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        weights.update({(i, t): w / norm for t, w in raw.items()})
    return df, vocab, weights


@pytest.mark.parametrize("n_max", [1, 2])
@pytest.mark.parametrize("broadcast_bytes", [10**6, 0])
def test_tfidf_matches_brute_force_by_both_joins(make, n_max, broadcast_bytes, monkeypatch):
    monkeypatch.setattr(features, "HEAVY_SHARE", 10)  # make some terms heavy
    rows = corpus()
    documents = stage(make(rows, SCHEMA), "docs")
    df, vocab, weights = brute_tfidf(rows, n_max, 3, 0.8)
    assert dict(rows_of(features.doc_freq(documents, n_max))) == dict(df)
    table = stage(features.fit_vocabulary(documents, n_max, 3, 0.8), "vocab")
    assert {r["term"]: r["idf"] for r in table.collect()} == pytest.approx(vocab)
    got = features.tfidf(documents, table, n_max, broadcast_bytes=broadcast_bytes)
    assert {(r[0], r[1]): r[2] for r in rows_of(got)} == pytest.approx(weights)
    norms = got.groupBy("row_id").agg(F.sum(F.col("weight") ** 2).alias("n2")).collect()
    assert all(r["n2"] == pytest.approx(1) for r in norms)


def test_term_counts_need_one_exchange(make):
    df = features.term_count(stage(make(corpus(), SCHEMA), "docs"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    want = {(i, t): k for i, text, _ in corpus() for t, k in Counter(tokens(text)).items()}
    assert {(r[0], r[1]): r[2] for r in rows_of(df)} == want


def test_mllib_vectors_equal_the_relational_weights(make):
    rows = corpus()
    documents = stage(make(rows, SCHEMA), "docs")
    for n_max in (1, 2):
        model = classifier.fit_features(documents, n_max, 3, 0.8)
        terms = model.stages[1].vocabulary
        _, _, weights = brute_tfidf(rows, n_max, 3, 0.8)
        got = {}
        for r in model.transform(documents).select("row_id", "features").collect():
            v: SparseVector = r["features"]
            got.update({(r["row_id"], terms[i]): x for i, x in zip(v.indices.tolist(), v.values.tolist())})
        assert got == pytest.approx(weights)


def test_grid_vocabulary_counts_terms_of_every_candidate(make):
    rows = corpus()
    grid = classifier.candidates({"ngram_max": (1, 2), "max_df": (0.5, 0.9), "min_df": (2, 5), "max_iter": (10,)})
    got = {r["candidate_id"]: r["n_terms"] for r in features.grid_vocabulary(stage(make(rows, SCHEMA), "d"), grid).collect()}
    for i, c in enumerate(grid):
        assert got[i] == len(brute_tfidf(rows, c["ngram_max"], c["min_df"], c["max_df"])[1])


def test_full_grid_order():
    grid = classifier.candidates()
    assert len(grid) == 16
    assert grid[0] == {"max_iter": 200, "max_df": 0.8, "min_df": 5, "ngram_max": 1}
    assert grid[1]["ngram_max"] == 2 and grid[8]["max_iter"] == 500


@pytest.mark.parametrize("broadcast_bytes", [10**6, 0])
def test_linear_scores_match_brute_force(make, broadcast_bytes, monkeypatch):
    monkeypatch.setattr(features, "HEAVY_SHARE", 10)
    rows = corpus()
    documents = stage(make(rows, SCHEMA), "docs")
    _, vocab, weights = brute_tfidf(rows, 1, 3, 0.8)
    coef = {(t, c): ((len(t) * 3 + k * 5) % 7 - 3) / 4 for t in vocab for k, c in enumerate(CLASSES)}
    intercepts = {"negative": 0.2, "neutral": 0.1, "positive": -0.3}
    table = stage(features.fit_vocabulary(documents, 1, 3, 0.8), "vocab")
    coefs = stage(make([(t, c, w) for (t, c), w in coef.items()], "term string, class string, weight double"), "coefs")
    direct = linear.score_texts(
        documents, stage(linear.scoring_table(table, coefs), "scoring"), intercepts,
        broadcast_bytes=broadcast_bytes,
    )
    stepwise = linear.linear_score(
        features.tfidf(documents, table), coefs, intercepts, documents, broadcast_bytes
    )
    for scored in (direct, stepwise):
        got = {r["row_id"]: r for r in scored.collect()}
        assert len(got) == len(rows)
        for i, _, _ in rows:
            z = {
                c: intercepts[c] + sum(w * coef[t, c] for (j, t), w in weights.items() if j == i)
                for c in CLASSES
            }
            total = sum(math.exp(v) for v in z.values())
            assert got[i]["probabilities"] == pytest.approx({c: math.exp(v) / total for c, v in z.items()})
            assert z[got[i]["sentiment"]] == pytest.approx(max(z.values()))


def test_ties_go_to_the_first_class(make):
    df = make([(1,)], "row_id bigint")
    logits = {c: F.lit(0.5) for c in CLASSES}
    assert linear.with_class_probabilities(df, logits).first()["sentiment"] == "negative"


def test_strip_matches_python(make):
    texts = ["\x1c\x85\xa0 a", "a​ ", "\t\n a b \r", " x ", "   ", "", "\x1fz\x1e"]
    df = make([(i, t) for i, t in enumerate(texts)], "row_id bigint, t string")
    got = dict(rows_of(df.select("row_id", strip(F.col("t")).alias("t"))))
    assert got == {i: t.strip() for i, t in enumerate(texts)}


def test_lookup_by_shuffle_scans_each_side_once(make, monkeypatch):
    monkeypatch.setattr(features, "HEAVY_SHARE", 10)
    long = "w" * 300  # length makes no difference
    rows = [*corpus(), *[(1000 + i, f"{long} {long} down", "neutral") for i in range(40)], (2000, None, "neutral")]
    documents = stage(make(rows, SCHEMA), "docs")
    table = stage(features.fit_vocabulary(documents, 1, 3, 1.0), "vocab")
    counts = features.term_count(documents, keep_empty=True)
    joined = features.lookup_terms(counts, table, 0, "left")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("docs-") == 1
    by_broadcast = features.lookup_terms(counts, table, 10**6, "left")
    assert rows_of(joined, "row_id", "term", "tf", "df") == rows_of(by_broadcast, "row_id", "term", "tf", "df")
    # Row 61 has words of one letter only.
    assert {r["row_id"] for r in joined.filter("term IS NULL").collect()} == {60, 61, 2000}


def test_scoring_reads_texts_once(make):
    documents = stage(make(corpus(), SCHEMA), "docs")
    table = stage(features.fit_vocabulary(documents, 1, 3, 0.8), "vocab")
    weights = table.select("term", F.explode(F.array(*[F.lit(c) for c in CLASSES])).alias("class"), F.lit(0.5).alias("weight"))
    table = stage(linear.scoring_table(table, weights), "scoring")
    for broadcast_bytes in (10**6, 0):
        scored = linear.score_texts(documents, table, dict.fromkeys(CLASSES, 0.0), broadcast_bytes=broadcast_bytes)
        assert scored._jdf.queryExecution().executedPlan().toString().count("docs-") == 1


def test_partitions_grow_with_the_texts_and_the_lines(make, monkeypatch):
    rows = corpus()
    size = sum(len(r[1].encode()) for r in rows)
    monkeypatch.setattr(features, "TASK_BYTES", size // 40)
    monkeypatch.setattr(features, "TASK_LINES", 20)
    documents = stage(make(rows, SCHEMA), "docs")
    vocab = stage(features.fit_vocabulary(documents, 1, 1, 1.0), "vocab")
    counts = features.term_count(documents)
    # Left to itself, Spark joins so little into one partition.
    assert counts.select(F.spark_partition_id()).distinct().count() > 8
    joined = features.lookup_terms(counts, vocab, 0)
    assert joined.select(F.spark_partition_id()).distinct().count() > 8
    by_broadcast = features.lookup_terms(counts, vocab, 10**6)
    assert sorted(joined.select("row_id", "term", "tf").collect()) == sorted(by_broadcast.select("row_id", "term", "tf").collect())
