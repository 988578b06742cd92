from __future__ import annotations

from multiprocessing.pool import ThreadPool

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F
from rows import rows_of

from tonegrain.functions.text import terms
from tonegrain.operators import classifier, encoder, metrics, registry
from tonegrain.operators.features import fit_vocabulary
from tonegrain.operators.metrics import macro_f1
from tonegrain.operators.split import stratified_kfold
from tonegrain.plans import training
from tonegrain.schema import CLASSES, NEWS_RAW
from tonegrain.sources.staging import stage

PAIRS = "class string, prediction string"


def test_f1_counts_labels_of_either_side(make):
    # neutral occurs in the truth only, negative in the predictions only
    df = make([("positive", "positive"), ("positive", "negative"), ("neutral", "positive")], PAIRS)
    got = {r["label"]: r for r in metrics.per_class(metrics.confusion(df)).collect()}
    assert got["positive"]["f1_score"] == pytest.approx(0.5)
    assert got["neutral"]["f1_score"] == 0 and got["neutral"]["support"] == 1
    assert got["negative"]["f1_score"] == 0 and got["negative"]["support"] == 0
    assert metrics.macro_f1(df).first()[0] == pytest.approx(0.5 / 3)


def test_report_adds_up_and_prints(make):
    df = make([("positive", "positive")] * 6 + [("neutral", "positive")] * 2 + [("neutral", "neutral")] * 2, PAIRS)
    report = metrics.classification_report(df)
    got = {r["label"]: r for r in report.collect()}
    assert got["accuracy"]["f1_score"] == pytest.approx(0.8)
    assert got["macro avg"]["recall"] == pytest.approx(0.75)
    assert got["weighted avg"]["precision"] == pytest.approx(0.6 * 0.75 + 0.4 * 1.0)
    text = metrics.report_text(report)
    assert text.splitlines()[1].split() == ["neutral", "1.00", "0.50", "0.67", "4"]
    assert text.splitlines()[3].split() == ["accuracy", "0.80", "10"]


def test_macro_f1_per_group_and_evaluator(make):
    df = make([(0, "a", "a"), (0, "b", "a"), (1, "a", "a"), (1, "b", "b")], f"fold int, {PAIRS}")
    got = dict(rows_of(metrics.macro_f1(df, by=["fold"])))
    assert got == pytest.approx({0: 1 / 3, 1: 1.0})
    ev = metrics.MacroF1Evaluator("class", "prediction")
    assert isinstance(ev, Evaluator) and ev.isLargerBetter()
    assert ev.evaluate(df) == pytest.approx(metrics.macro_f1(df).first()[0])


def test_cv_results_rank_and_first_best(make):
    df = make(
        [(0, 0, 0.5), (0, 1, 0.7), (1, 0, 0.6), (1, 1, 0.6), (2, 0, 0.1), (2, 1, 0.1)],
        "candidate_id bigint, fold int, score double",
    )
    results = classifier.cv_results(df.withColumn("score", F.round("score", 3)))
    assert dict(rows_of(results, "candidate_id", "rank"))[2] == 3
    assert classifier.best_candidate(results).first()["candidate_id"] == 0


def news(n=240):
    """Texts whose words give their class away."""
    words = {"positive": "rally surge gain", "negative": "crash hack loss", "neutral": "flat wait hold"}
    rows = []
    for i in range(n):
        c = CLASSES[i % 3]
        rows.append(
            (
                i, f"2024-01-{1 + i % 28:02d} 00:00:00",
                f"{{'class': '{c}', 'polarity': 0.1, 'subjectivity': 0.2}}",
                "src", "btc", f"item {i}", f"{words[c]} {words[c].split()[i % 3]} market news n{i}",
            )
        )
    return rows


@pytest.fixture(scope="module")
def data(spark):
    raw = spark.createDataFrame(news(), NEWS_RAW)
    return training.prepare_data(raw)


GRID = [
    {"ngram_max": 1, "min_df": 2, "max_df": 0.9, "max_iter": 5},
    {"ngram_max": 2, "min_df": 2, "max_df": 0.9, "max_iter": 5},
    {"ngram_max": 2, "min_df": 2, "max_df": 0.9, "max_iter": 8},
]


def test_training_learns_saves_and_serves(spark, data, tmp_path):
    assert rows_of(data.groupBy("split").count()) == [("test", 60), ("train", 180)]
    reg = registry.Registry(spark, str(tmp_path / "registry"))
    with pytest.raises(LookupError):
        reg.load_model("linear")
    version = training.run_linear_training(data, reg, "linear", "search", GRID, k=2, parallelism=2)
    assert version == 1
    assert reg.read("metrics").first()["value"] == pytest.approx(1.0)
    assert reg.read("runs").first()["run_name"].startswith("search 2")
    assert "macro avg" in reg.read("reports").first()["report"]
    model = reg.load_model("linear")
    test = data.filter("split = 'test'")
    scored = classifier.predict_proba(model, test)
    assert scored.filter("class != prediction").count() == 0
    for r in scored.limit(5).collect():
        assert sum(r["probabilities"].values()) == pytest.approx(1)
        assert max(r["probabilities"], key=r["probabilities"].get) == r["prediction"]
    kept = reg.read("cv_results").orderBy("candidate_id").collect()
    assert [dict(r["params"]) for r in kept] == [{n: str(v) for n, v in c.items()} for c in GRID]
    assert {r["run_id"] for r in kept} == {reg.read("runs").first()["run_id"]} and kept[0]["rank"] >= 1
    assert reg.read("runs").first()["experiment"] == "Default"
    meta = reg.meta("linear").first()
    assert (meta["alias"], meta["version"]) == ("production", 1)
    # an equal score does not take over
    assert reg.save_model("linear", model, "r2", 1.0, {}) == 2
    reg.promote("linear", 2)
    assert reg.meta("linear").first()["version"] == 1


def test_encoder_evaluation_registers_its_own_name(spark, data, tmp_path):
    reg = registry.Registry(spark, str(tmp_path / "registry"))
    lexicon = {"positive": ["rally", "surge", "gain"], "negative": ["crash", "hack", "loss"]}
    training.run_encoder_evaluation(
        data, reg, "encoder", "encoder", "lexicon", encoder.lexicon_factory(lexicon)
    )
    assert reg.read("metrics").first()["value"] == pytest.approx(1.0)
    assert reg.read("runs").first()["params"]["batch_size"] == "16"
    assert reg.load_model("encoder").transform(data.limit(1)).first()["model_id"] == "lexicon"


def test_encoder_batches_keep_rows_in_place(make):
    rows = [(i, "up " * (i % 4) + "down " * (i % 3)) for i in range(100)]
    make_fn = encoder.lexicon_factory({"positive": ["up"], "negative": ["down"]})
    got = {
        r["row_id"]: r
        for r in encoder.score_batches(make(rows, "row_id bigint, input_text string"), make_fn).collect()
    }
    for i, _ in rows:
        up, down = i % 4, i % 3
        want = "positive" if up > down else "negative" if down > up else "neutral"
        assert got[i]["sentiment"] == want
        assert got[i]["score"] == pytest.approx(max(up, down) / (up + down) if up + down else 0)
        assert got[i]["latency_ms"] >= 0


def test_token_limit_reaches_the_model(make):
    def make_fn(max_length):
        return lambda texts: ([f"limit {max_length}"] * len(texts), [1.0] * len(texts))

    df = make([(1, "up")], "row_id bigint, input_text string")
    assert encoder.score_batches(df, make_fn, max_length=2).first()["sentiment"] == "limit 2"


VERSIONS = "name string, version bigint, run_id string, test_f1_score double"
ALIASES = "name string, alias string, version bigint"


@pytest.mark.parametrize(
    ("held", "held_score", "offered_score", "winner"),
    [(None, None, 0.1, 2), (1, None, 0.1, 2), (1, 0.5, 0.5, 1), (1, 0.5, 0.6, 2), (1, 0.5, 0.4, 1)],
)
def test_promotion_rules(make, held, held_score, offered_score, winner):
    versions = make([("m", 1, "a", held_score), ("m", 2, "b", offered_score)], VERSIONS)
    aliases = make([("m", "production", held)] if held else [], ALIASES)
    others = make([("m", "staging", 9), ("other", "production", 4)], ALIASES)
    after = registry.promote(versions, aliases.unionByName(others), versions.filter("version = 2"))
    assert rows_of(after) == sorted(
        [("m", "production", winner), ("m", "staging", 9), ("other", "production", 4)], key=repr
    )


def test_promotion_history_and_nan(make):
    rows = [("m", i, f"2024-01-0{i + 1} 00:00:00", s) for i, s in enumerate([0.3, 0.3, 0.5, 0.4, 0.6])]
    runs = make(rows, "name string, run_id bigint, logged_at string, test_f1_score double").withColumn(
        "logged_at", F.to_timestamp("logged_at")
    )
    got = rows_of(registry.promotion_history(runs), "version", "promoted")
    assert got == [(1, True), (2, False), (3, True), (4, False), (5, True)]
    broken = runs.withColumn("test_f1_score", F.lit(float("nan")))
    with pytest.raises(Exception, match="NaN"):
        registry.promotion_history(broken).collect()


def test_versions_continue_after_the_existing_ones(make):
    runs = make([("m", 1, 10), ("m", 2, 5), ("k", 3, 1)], "name string, run_id bigint, logged_at bigint")
    existing = make([("m", 7)], "name string, version bigint")
    got = registry.assign_version(runs, existing)
    assert rows_of(got, "name", "run_id", "version") == [("k", 3, 1), ("m", 1, 9), ("m", 2, 8)]


def test_production_meta_of_an_unknown_name(make):
    names = make([("m",), ("x",)], "name string")
    aliases = make([("m", "production", 3), ("x", "staging", 1)], ALIASES)
    versions = make([("m", 3, "run", 0.5), ("x", 1, "r", 0.1)], VERSIONS)
    assert rows_of(registry.production_meta(names, aliases, versions), "name", "alias", "version", "run_id") == [
        ("m", "production", 3, "run"), ("x", "production", None, None),
    ]


def test_vectors_are_staged_for_training(data):
    vectors = classifier.fit_features(data, 1, 2, 0.9).transform(data).select("class", "features")
    model = classifier.train_logreg(stage(vectors, "vectors"), 5)
    assert model.transform(vectors).filter("class != prediction").count() == 0


def test_grid_features_equal_separate_fits(spark, data, monkeypatch):
    train, k = data.filter("split = 'train'"), 3
    splits = []
    monkeypatch.setattr(classifier, "terms", lambda *a: splits.append(a) or terms(*a))
    grid = classifier.GridFeatures(train, GRID + [{**GRID[0], "min_df": 70, "max_df": 0.2}], k, 5)
    assert len(splits) == 1  # the texts are split into terms once
    folded = stage(stratified_kfold(train.select("row_id", "input_text", "class"), "class", "row_id", k, 5), "folds")
    for n, least, most in ((1, 2, 0.9), (2, 2, 0.9), (2, 5, 0.5)):
        for fold in range(k):
            part = folded.filter(F.col("fold") != fold)
            vocab = dict(rows_of(fit_vocabulary(part, n, least, most), "term", "idf"))
            names = grid.vectors.select(f"counts{n}").first()[0].size
            weights = grid.idf(fold, n, least, most)
            assert names == len(weights) and sorted(weights[weights > 0]) == pytest.approx(sorted(vocab.values()))
            model = classifier.fit_features(part, n, least, most)
            for inside, own in zip((False, True), grid.vectors_of(fold, n, least, most), strict=True):
                rows = folded.filter((F.col("fold") == fold) == inside)
                want = sorted((r["class"], sorted(round(x, 9) for x in r["features"].toArray() if x)) for r in model.transform(rows).collect())
                got = sorted((r["class"], sorted(round(x, 9) for x in r["features"].toArray() if x)) for r in own.collect())
                assert got == want
    assert not grid.idf(0, 1, 70, 0.2).any()  # a setting that knows no term


def test_cross_validation_equals_separate_fits(data):
    train, k = data.filter("split = 'train'"), 2
    got = {(r["candidate_id"], r["fold"]): r["score"] for r in classifier.cross_validate(train, GRID, k, 5).collect()}
    folded = stage(stratified_kfold(train.select("row_id", "input_text", "class"), "class", "row_id", k, 5), "folds")
    for i, c in enumerate(GRID):
        for fold in range(k):
            model = classifier.fit_classifier(folded.filter(F.col("fold") != fold), **c)
            want = macro_f1(classifier.predict(model, folded.filter(F.col("fold") == fold))).first()["macro_f1"]
            assert got[i, fold] == pytest.approx(want)


def test_settings_with_the_same_terms_share_their_fits(data, monkeypatch):
    train, fits, fit = data.filter("split = 'train'"), [], classifier.train_logreg
    monkeypatch.setattr(classifier, "train_logreg", lambda v, n: fits.append(n) or fit(v, n))

    def scores(grid):
        fits.clear()
        return {(r["candidate_id"], r["fold"]): r["score"] for r in classifier.cross_validate(train, grid, 2, 5).collect()}

    grid = GRID[:1]
    once, n_once = scores(grid), len(fits)
    # No term's share lies between 0.9 and 0.95; 0.2 keeps fewer terms.
    more = scores([*grid, {**grid[0], "max_df": 0.95}, {**grid[0], "max_df": 0.2}])
    assert {(i, fold): x for (i, fold), x in more.items() if i < 2} == pytest.approx({(i, fold): x for (_, fold), x in once.items() for i in (0, 1)})
    assert len(more) == 6 and len(fits) == 2 * n_once


def side_by_side(*jobs):
    with ThreadPool(len(jobs)) as pool:
        return pool.map(lambda job: job(), jobs, chunksize=1)


def test_writers_of_one_name_get_versions_of_their_own(spark, tmp_path):
    root = str(tmp_path / "registry")
    note = PipelineModel([SQLTransformer(statement="SELECT * FROM __THIS__")])

    def save(i):
        return registry.Registry(spark, root).save_model("a/b", note, f"r{i}", i / 10, {})

    assert sorted(side_by_side(*[lambda i=i: save(i) for i in range(3)])) == [1, 2, 3]
    reg = registry.Registry(spark, root)
    assert rows_of(reg.read("model_versions"), "version") == [(1,), (2,), (3,)]
    assert len({r[0] for r in rows_of(reg.read("model_versions"), "path")}) == 3
    assert not reg._claim(f"{root}/claims/version/a%2Fb/2") and save(9) == 4


def test_promotions_at_one_time_are_all_kept(spark, tmp_path):
    root = str(tmp_path / "registry")
    note, reg = PipelineModel([SQLTransformer(statement="SELECT * FROM __THIS__")]), registry.Registry(spark, root)
    for name in "abc":
        reg.save_model(name, note, "r", 0.5, {})
    side_by_side(*[lambda n=n: registry.Registry(spark, root).promote(n, 1) for n in "abc"])
    assert rows_of(reg.read("aliases")) == [(n, "production", 1) for n in "abc"]


def test_a_lost_writer_of_aliases_holds_nobody_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(registry, "PATIENCE", 0.5)
    note, reg = PipelineModel([SQLTransformer(statement="SELECT * FROM __THIS__")]), registry.Registry(spark, str(tmp_path / "registry"))
    reg.save_model("a", note, "r", 0.5, {})
    assert reg._claim(f"{reg.root}/claims/aliases/1")  # claimed, never written
    reg.promote("a", 1)
    assert rows_of(reg.read("aliases")) == [("a", "production", 1)]
