"""The query catalogue: each entry runs one operator on the driver tables.

Entries take ``(spark, sf_dir)``, read whole tables and return a DataFrame.
Inputs scanned more than once are staged first. Doubles are rounded to six
places, since the order of a sum is not fixed.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonegrain.functions.text import terms
from tonegrain.operators import (
    analytics,
    classifier,
    clean,
    cube,
    dedup,
    encoder,
    features,
    linear,
    metrics,
    profile,
    registry,
    requests,
    serving,
    sharded,
    split,
)
from tonegrain.plans import training
from tonegrain.schema import CLASSES, NEWS_RAW
from tonegrain.session import pin
from tonegrain.sources import fixtures
from tonegrain.sources import news as news_source
from tonegrain.sources import requests as request_source
from tonegrain.sources.staging import new_path, stage
from tonegrain.streaming import streams, trends

Query = Callable[[SparkSession, str], DataFrame]

SEED = training.RANDOM_STATE
INTERCEPTS = {"negative": -0.1, "neutral": 0.0, "positive": 0.1}
MODEL_URI = "models:/linear@production"

# Words that occur in the driver documents; they stand in for a sentiment lexicon.
LEXICON = {
    "positive": ("the", "is", "with", "this", "that", "la", "der", "und", "les"),
    "negative": ("of", "was", "not", "by", "are", "que", "nicht", "des", "los"),
}

# Grid fits run side by side, as each is small here.
PARALLELISM = 6

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register a query under the name of its function."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(pin(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def rounded(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.round(f.name, 6).alias(f.name) if isinstance(f.dataType, T.DoubleType) else f.name
            for f in df.schema.fields
        ]
    )


_news_tables: dict[tuple[str, str], str] = {}


def _raw_path(spark: SparkSession, sf_dir: str) -> str:
    """The raw news table, derived once per session from the driver tables.

    The engine's input is a Parquet table; mapping documents onto it is no part
    of any query.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _news_tables:
        path = new_path(spark, "news-raw")
        fixtures.load_news(spark, sf_dir).write.parquet(path)
        _news_tables[key] = path
    return _news_tables[key]


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(NEWS_RAW).parquet(_raw_path(spark, sf_dir))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.parse_news(_raw(spark, sf_dir))


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_table(_raw(spark, sf_dir))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model inputs, staged: feature queries scan them more than once."""
    return stage(clean.feature_projection(_clean(spark, sf_dir)), "documents")


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.predictions(_clean(spark, sf_dir))


def _linear_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predictions(spark, sf_dir).select(
        "row_id", "class", F.col("pred_linear").alias("prediction")
    )


def _scoring_table(documents: DataFrame) -> DataFrame:
    vocab = stage(features.fit_vocabulary(documents), "vocab")
    return stage(linear.scoring_table(vocab, fixtures.coefficients(vocab)), "scoring")


def _flat_probabilities(df: DataFrame) -> DataFrame:
    return df.select(
        *[c for c in df.columns if c != "probabilities"],
        *[F.col("probabilities")[c].alias(f"p_{c}") for c in CLASSES],
    )


# --- sources and sinks -----------------------------------------------------


@query
def csv_scan(spark, sf_dir):
    """A file without ``row_id``, in another column order, with a column that is not ours."""
    path = new_path(spark, "news-csv")
    columns = ["title", F.lit("x").alias("url"), "text", "sentiment", "subject", "date", "source"]
    news_source.write_news_csv(_raw(spark, sf_dir).select(*columns), path)
    return news_source.read_news(spark, path).drop("row_id")


@query
def na_normalise(spark, sf_dir):
    return news_source.na_normalise(_raw(spark, sf_dir))


@query
def load_stats(spark, sf_dir):
    return news_source.load_stats(_raw(spark, sf_dir))


@query
def run_log(spark, sf_dir):
    predictions = stage(_predictions(spark, sf_dir), "predictions")
    reg = registry.Registry(spark)
    for model in ("linear", "encoder"):
        counts = stage(metrics.confusion(predictions, prediction=f"pred_{model}"), "confusion")
        classes = metrics.per_class(counts)
        score = classes.agg(F.avg("f1_score").alias("test_f1_score"))
        report = metrics.report_text(metrics.report_lines(classes))
        metric = score.select(F.lit("test_f1_score").alias("metric"), F.col("test_f1_score").alias("value"))
        reg.log_run(f"run-{model}", model, {"column": f"pred_{model}"}, metric, report)
    logged = reg.read("runs").join(reg.read("metrics"), "run_id").join(reg.read("reports"), "run_id")
    return rounded(
        logged.select(
            "run_id", F.col("params")["column"].alias("prediction_column"), "metric", "value"
        )
    )


@query
def request_scan(spark, sf_dir):
    path = new_path(spark, "requests")
    fixtures.load_requests(spark, sf_dir).write.json(path)
    return request_source.read_requests(spark, path).select(
        "request_id", "input_text", F.array_join("input_texts", "\n").alias("input_texts")
    )


@query
def response_sink(spark, sf_dir):
    table = _scoring_table(_documents(spark, sf_dir))
    reqs = fixtures.load_requests(spark, sf_dir)
    scored = stage(requests.score_requests(reqs, lambda t: linear.score_texts(t, table, INTERCEPTS)), "scored")
    path = new_path(spark, "responses")
    envelopes = requests.responses(scored.withColumn("latency_ms", F.lit(7.6)), MODEL_URI)
    request_source.write_responses(envelopes, path)
    written = spark.read.schema(envelopes.schema).json(path)
    return written.select(
        "request_id",
        "model_uri",
        F.size("predictions").cast("bigint").alias("n_predictions"),
        F.array_join("predictions.sentiment", ",").alias("sentiments"),
        F.round(F.aggregate(
            F.flatten(F.transform("predictions.probabilities", F.map_values)), F.lit(0.0), lambda a, x: a + x
        ), 6).alias("probability_sum"),
        F.col("latency_ms").cast("bigint").alias("latency_ms"),
    )


# --- cleaning --------------------------------------------------------------


@query
def coerce_date(spark, sf_dir):
    return clean.coerce_date(_raw(spark, sf_dir)).select("row_id", "date")


@query
def drop_missing_mandatory(spark, sf_dir):
    return clean.drop_missing_mandatory(clean.coerce_date(_raw(spark, sf_dir)))


@query
def drop_missing_body(spark, sf_dir):
    return clean.drop_missing_body(_raw(spark, sf_dir))


@query
def reject_report(spark, sf_dir):
    return clean.reject_report(_raw(spark, sf_dir))


@query
def reject_rows(spark, sf_dir):
    return clean.rejected_rows(_raw(spark, sf_dir)).select("row_id", "reject_reason")


@query
def parse_sentiment(spark, sf_dir):
    parsed = clean.parse_sentiment(_raw(spark, sf_dir))
    return parsed.select("row_id", "class", "polarity", "subjectivity")


@query
def coerce_scores(spark, sf_dir):
    scored = clean.coerce_scores(clean.parse_sentiment(_raw(spark, sf_dir)))
    return scored.select("row_id", "polarity", "subjectivity")


@query
def valid_class(spark, sf_dir):
    return clean.valid_class(clean.parse_sentiment(_raw(spark, sf_dir))).select("row_id", "class")


@query
def build_input_text(spark, sf_dir):
    return clean.build_input_text(_raw(spark, sf_dir)).select("row_id", "input_text")


@query
def feature_projection(spark, sf_dir):
    return clean.feature_projection(_clean(spark, sf_dir))


@query
def clean_news(spark, sf_dir):
    return _clean(spark, sf_dir)


@query
def dashboard_filter(spark, sf_dir):
    path = new_path(spark, "news-clean")
    news_source.write_clean(_clean(spark, sf_dir), path)
    return analytics.dashboard_filter(
        news_source.read_clean(spark, path),
        start=dt.date(2024, 2, 1),
        end=dt.date(2024, 9, 30),
        sources=[f"src{i}" for i in range(15)],
        subjects=["en", "fr", "de"],
    ).drop("month")


@query
def request_clean(spark, sf_dir):
    return requests.clean_requests(fixtures.load_requests(spark, sf_dir))[0]


@query
def request_reject(spark, sf_dir):
    return requests.request_reject(fixtures.load_requests(spark, sf_dir))


@query
def request_validate(spark, sf_dir):
    return requests.request_validate(fixtures.load_requests(spark, sf_dir))


@query
def invalid_dates(spark, sf_dir):
    return clean.invalid_dates(_raw(spark, sf_dir))


# --- duplicates ------------------------------------------------------------


@query
def dedup_keep_first(spark, sf_dir):
    return dedup.dedup_keep_first(_parsed(spark, sf_dir)).select("row_id", "date", "class")


@query
def dup_ratio(spark, sf_dir):
    return rounded(dedup.dup_ratio(_parsed(spark, sf_dir), "text"))


@query
def dup_text_rows(spark, sf_dir):
    return dedup.duplicate_rows(_raw(spark, sf_dir).select("row_id", "text"), ["text"])


@query
def dup_title_rows(spark, sf_dir):
    return dedup.duplicate_rows(_raw(spark, sf_dir).select("row_id", "title"), ["title"])


@query
def dup_text_title_rows(spark, sf_dir):
    rows = _raw(spark, sf_dir).select("row_id", "title", "text")
    return dedup.duplicate_rows(rows, ["title", "text"])


@query
def removed_rows(spark, sf_dir):
    return dedup.removed_rows(_parsed(spark, sf_dir)).select("row_id", "date", "title", "text", "class")


# --- profiling -------------------------------------------------------------


@query
def class_count(spark, sf_dir):
    return profile.class_count(_clean(spark, sf_dir))


@query
def class_ratio(spark, sf_dir):
    return rounded(profile.class_ratio(_clean(spark, sf_dir)))


@query
def date_range(spark, sf_dir):
    return profile.date_range(_parsed(spark, sf_dir))


@query
def null_flags(spark, sf_dir):
    return profile.null_flags(
        _parsed(spark, sf_dir), ["date", "sentiment", "source", "subject", "text", "title"]
    )


@query
def table_profile(spark, sf_dir):
    return profile.table_profile(_parsed(spark, sf_dir))


@query
def head_rows(spark, sf_dir):
    return profile.head_rows(_raw(spark, sf_dir))


def _register_distinct(column: str, operator: Callable[[DataFrame, str], DataFrame]) -> None:
    def run(spark, sf_dir):
        return operator(_parsed(spark, sf_dir), column)

    run.__name__ = f"distinct_{column}"
    query(run)


for _column in ("source", "subject", "class"):
    _register_distinct(_column, profile.distinct_values)
for _column in ("polarity", "subjectivity"):
    _register_distinct(_column, profile.distinct_sorted)


@query
def text_len_by_class(spark, sf_dir):
    return rounded(profile.text_len_by_class(_parsed(spark, sf_dir)))


def _quartiles_hold(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Whether quartiles from merged monthly sketches keep twice their usual rank error."""
    rows = stage(rows, "values")
    sketches = stage(profile.quantile_sketches(rows, group, value), "sketches")
    errors = profile.rank_errors(rows, profile.merged_quantiles(sketches, group), group, value)
    limit = 2 * profile.sketch_rank_error()
    return errors.select(group, "n_rows", *[(F.col(f"{p}_error") <= limit).alias(f"{p}_holds") for p in ("p25", "p50", "p75")])


@query
def text_len_sketch(spark, sf_dir):
    lengths = _parsed(spark, sf_dir).select("class", "date", F.length("text").alias("text_len"))
    return _quartiles_hold(lengths.filter(F.col("text_len").isNotNull()), "class", "text_len")


@query
def confusion(spark, sf_dir):
    return metrics.confusion(_linear_predictions(spark, sf_dir))


@query
def macro_f1(spark, sf_dir):
    return rounded(metrics.macro_f1(_linear_predictions(spark, sf_dir)))


@query
def classification_report(spark, sf_dir):
    return rounded(metrics.classification_report(_linear_predictions(spark, sf_dir)))


@query
def class_weight(spark, sf_dir):
    return rounded(classifier.class_weight(_clean(spark, sf_dir)))


# --- dashboard -------------------------------------------------------------


@query
def trend_count(spark, sf_dir):
    return analytics.trend(_clean(spark, sf_dir), "day", "count")


def _register_trend_grain(grain: str) -> None:
    def run(spark, sf_dir):
        return analytics.trend(_clean(spark, sf_dir), grain, "count")

    run.__name__ = f"trend_count_{grain}"
    query(run)


for _grain in ("week", "month", "year"):
    _register_trend_grain(_grain)


@query
def trend_count_filled(spark, sf_dir):
    counts = stage(analytics.trend(_clean(spark, sf_dir), "day", "count"), "trend")
    return analytics.fill_buckets(counts, "day")


@query
def trend_share(spark, sf_dir):
    return rounded(analytics.trend(_clean(spark, sf_dir), "day", "share"))


@query
def trend_polarity(spark, sf_dir):
    return rounded(analytics.trend(_clean(spark, sf_dir), "day", "polarity"))


@query
def trend_subjectivity(spark, sf_dir):
    return rounded(analytics.trend(_clean(spark, sf_dir), "day", "subjectivity"))


@query
def by_source(spark, sf_dir):
    return rounded(analytics.breakdown(_clean(spark, sf_dir), "source"))


@query
def by_subject(spark, sf_dir):
    return rounded(analytics.breakdown(_clean(spark, sf_dir), "subject"))


@query
def breakdown_sets(spark, sf_dir):
    return analytics.breakdown_sets(_clean(spark, sf_dir))


def _cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored cube, written whole and then again for the months of the later half of the rows."""
    path, lines = new_path(spark, "news-clean"), new_path(spark, "news-cube")
    # The cube reads neither titles nor texts, so they need not be stored for it.
    rows = _clean(spark, sf_dir).select("date", "class", "source", "subject", *cube.MEASURES)
    news_source.write_clean(rows, path)
    stored = news_source.read_clean(spark, path)
    cube.refresh(spark, stored, lines)
    cube.refresh(spark, stored, lines, cube.months_of(stored.filter(F.col("date") >= F.lit(dt.date(2024, 7, 1)))))
    return cube.read_cube(spark, lines)


@query
def cube_trends(spark, sf_dir):
    """Counts, shares and mean scores per week, from the cube."""
    lines = _cube(spark, sf_dir)
    means = cube.trend(lines, "week", "polarity").join(cube.trend(lines, "week", "subjectivity"), "bucket")
    return rounded(cube.trend(lines, "week", "share").join(means, "bucket"))


@query
def cube_breakdowns(spark, sf_dir):
    """Breakdowns by source, by subject and overall, from the cube filtered by days."""
    days = analytics.dashboard_filter(_cube(spark, sf_dir), dt.date(2024, 2, 10), dt.date(2024, 9, 20))
    return cube.breakdown_sets(days)


@query
def latest_samples(spark, sf_dir):
    return analytics.latest(_clean(spark, sf_dir), "subject", "en", 10)


@query
def latest_per_group(spark, sf_dir):
    newest = analytics.latest_per_group(_clean(spark, sf_dir), "source", 10)
    return newest.withColumn("rank", F.col("rank").cast("bigint"))


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    predictions = stage(_predictions(spark, sf_dir), "predictions")
    return analytics.compare(
        predictions.select("row_id", "class", F.col("pred_linear").alias("prediction")),
        predictions.select("row_id", F.col("pred_encoder").alias("prediction")),
    )


@query
def model_compare(spark, sf_dir):
    return _compared(spark, sf_dir)


@query
def match_rate(spark, sf_dir):
    return rounded(analytics.match_rate(_compared(spark, sf_dir)))


@query
def latency_summary(spark, sf_dir):
    both = F.array(
        *[
            F.struct(F.lit(m).alias("model"), F.col(f"latency_{m}_ms").alias("latency_ms"))
            for m in ("linear", "encoder")
        ]
    )
    return rounded(analytics.latency_summary(_predictions(spark, sf_dir).select(F.inline(both))))


@query
def latency_sketch(spark, sf_dir):
    both = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"latency_{m}_ms").alias("latency_ms")) for m in ("linear", "encoder")])
    return _quartiles_hold(_predictions(spark, sf_dir).select("date", F.inline(both)), "model", "latency_ms")


# --- splits ----------------------------------------------------------------


@query
def stratified_split(spark, sf_dir):
    labels = stage(_clean(spark, sf_dir).select("row_id", "class"), "labels")
    return split.stratified_split(labels, "class", "row_id", SEED)


@query
def stratified_kfold(spark, sf_dir):
    labels = stage(_clean(spark, sf_dir).select("row_id", "class"), "labels")
    return split.stratified_kfold(labels, "class", "row_id", classifier.FOLDS, SEED)


# --- text features ---------------------------------------------------------


@query
def tokenize(spark, sf_dir):
    tokens = features.tokenize(clean.feature_projection(_clean(spark, sf_dir)))
    return tokens.select(
        "row_id",
        F.size("tokens").cast("bigint").alias("n_tokens"),
        F.array_join("tokens", " ").alias("tokens"),
    )


@query
def ngrams(spark, sf_dir):
    grams = features.ngrams(clean.feature_projection(_clean(spark, sf_dir)), 2)
    return grams.select(
        "row_id",
        F.size("terms").cast("bigint").alias("n_terms"),
        F.array_join("terms", "|").alias("terms"),
    )


@query
def term_count(spark, sf_dir):
    return features.term_count(_documents(spark, sf_dir))


@query
def doc_freq(spark, sf_dir):
    return features.doc_freq(_clean(spark, sf_dir))


@query
def vocab_prune(spark, sf_dir):
    documents = _documents(spark, sf_dir)
    kept = features.vocab_prune(features.doc_freq(documents), documents)
    return kept.select("term", "df")


@query
def idf(spark, sf_dir):
    return rounded(features.fit_vocabulary(_documents(spark, sf_dir)).select("term", "idf"))


@query
def tfidf(spark, sf_dir):
    documents = _documents(spark, sf_dir)
    vocab = stage(features.fit_vocabulary(documents), "vocab")
    return rounded(features.tfidf(documents, vocab))


# --- models ----------------------------------------------------------------


def _split_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    documents = _documents(spark, sf_dir)
    parts = stage(split.stratified_split(documents, "class", "row_id", SEED), "split")
    return tuple(parts.filter(F.col("split") == s) for s in ("train", "test"))


def _known(label: str) -> Column:
    return F.col(label).isin(*CLASSES)


def _share(score: str) -> Column:
    """Whether a score lies between 0 and 1; null if there is none."""
    return F.col(score).between(0.0, 1.0)


def _fitted(train: DataFrame):
    return classifier.fit_classifier(train, **classifier.candidates()[0])


@query
def train_logreg(spark, sf_dir):
    documents = _documents(spark, sf_dir)
    vectors = classifier.fit_features(documents).transform(documents)
    vectors = stage(vectors.select("class", "features"), "vectors")
    return _learnt(classifier.train_logreg(vectors).transform(vectors))


def _learnt(predicted: DataFrame) -> DataFrame:
    """Rows of each class, and whether its predictions are classes and find it."""
    pairs = metrics.confusion(predicted)
    right = F.sum(F.when(F.col("class") == F.col("prediction"), F.col("n_rows")).otherwise(0))
    # Balanced weights: a class is found more often than by chance.
    return pairs.groupBy("class").agg(
        F.sum("n_rows").alias("n_rows"), F.bool_and(_known("prediction")).alias("known"),
        (right * len(CLASSES) > F.sum("n_rows")).alias("learnt"),
    )


@query
def train_sharded(spark, sf_dir):
    documents = _documents(spark, sf_dir)
    vocab = stage(features.fit_vocabulary(documents), "vocab")
    weights = stage(features.tfidf(documents, vocab), "weights")
    coefs, intercepts = sharded.train(weights, vocab, documents)
    scored = linear.linear_score(weights, coefs, intercepts, documents)
    return _learnt(documents.join(scored.withColumnRenamed("sentiment", "prediction"), "row_id"))


@query
def grid(spark, sf_dir):
    return features.grid_vocabulary(_documents(spark, sf_dir), classifier.candidates())


@query
def grid_search(spark, sf_dir):
    train, _ = _split_documents(spark, sf_dir)
    _, _, results = classifier.grid_search(train, seed=SEED, parallelism=PARALLELISM)
    grid = classifier.candidates()
    first = F.col("rank") == 1
    return classifier.with_params(results, grid).select(
        "candidate_id", *[F.col("params")[name].alias(name) for name in grid[0]],
        _share("mean_score").alias("scored"), F.col("rank").between(1, len(grid)).alias("ranked"),
        (F.max(F.when(first, F.col("mean_score"))).over(Window.partitionBy(F.lit(0))) >= F.col("mean_score")).alias("below_first"),
    )


@query
def cv_results(spark, sf_dir):
    predictions = stage(_predictions(spark, sf_dir), "predictions")
    folded = split.stratified_kfold(predictions, "class", "row_id", classifier.FOLDS, SEED)
    both = F.array(
        *[
            F.struct(F.lit(i).cast("bigint").alias("candidate_id"), F.col(f"pred_{m}").alias("prediction"))
            for i, m in enumerate(("linear", "encoder"))
        ]
    )
    scored = folded.select("class", "fold", F.inline(both))
    scores = metrics.macro_f1(scored, by=["candidate_id", "fold"])
    results = classifier.cv_results(scores.withColumnRenamed("macro_f1", "score"))
    return rounded(results.withColumn("rank", F.col("rank").cast("bigint")))


@query
def predict(spark, sf_dir):
    train, test = _split_documents(spark, sf_dir)
    return classifier.predict(_fitted(train), test).select("row_id", "class", _known("prediction").alias("known"))


@query
def predict_proba(spark, sf_dir):
    train, test = _split_documents(spark, sf_dir)
    scored = classifier.predict_proba(_fitted(train), test)
    p = F.map_values("probabilities")
    return scored.select(
        "row_id", F.round(F.aggregate(p, F.lit(0.0), lambda a, x: a + x), 6).alias("probability_sum"),
        (F.col("probabilities")[F.col("prediction")] == F.array_max(p)).alias("likeliest"),
    )


@query
def linear_score(spark, sf_dir):
    documents = _documents(spark, sf_dir)
    vocab = stage(features.fit_vocabulary(documents), "vocab")
    coefs = stage(fixtures.coefficients(vocab), "coefs")
    weights = features.tfidf(documents, vocab)
    scored = linear.linear_score(weights, coefs, INTERCEPTS, documents)
    return rounded(_flat_probabilities(scored))


@query
def score_texts(spark, sf_dir):
    documents = _documents(spark, sf_dir)
    scored = linear.score_texts(documents, _scoring_table(documents), INTERCEPTS)
    return rounded(_flat_probabilities(scored))


@query
def encoder_score(spark, sf_dir):
    documents = clean.feature_projection(_clean(spark, sf_dir))
    # The lexicon has no token limit: it reads whole texts.
    scored = encoder.score_batches(documents, encoder.lexicon_factory(LEXICON), max_length=None)
    return rounded(scored.select("row_id", "sentiment", "score"))


@query
def evaluate_model(spark, sf_dir):
    train, test = _split_documents(spark, sf_dir)
    scored = classifier.predict(_fitted(train), test).select("class", "prediction")
    report = metrics.classification_report(scored)
    return report.select("label", "support", *[_share(c).alias(c) for c in ("precision", "recall", "f1_score")])


@query
def score_requests(spark, sf_dir):
    table = _scoring_table(_documents(spark, sf_dir))
    reqs = fixtures.load_requests(spark, sf_dir)
    scored = requests.score_requests(reqs, lambda t: linear.score_texts(t, table, INTERCEPTS))
    return rounded(_flat_probabilities(scored.drop("request_no")))


def _served(envelopes: DataFrame) -> DataFrame:
    """A line per item of response envelopes, without what rests on the fit."""
    sums = F.aggregate(F.map_values("item.probabilities"), F.lit(0.0), lambda a, x: a + x)
    return envelopes.select("request_id", "model_uri", "meta", "latency_ms", F.explode("predictions").alias("item")).select(
        "request_id", F.col("item.pos").alias("pos"), "model_uri",
        F.col("meta")["name"].alias("name"), F.col("meta")["alias"].alias("alias"),
        F.col("meta")["version"].cast("bigint").alias("version"), F.col("meta")["run_id"].alias("run_id"),
        F.round(sums, 6).alias("probability_sum"), F.col("item.sentiment").isin(*CLASSES).alias("known"),
        (F.col("latency_ms") >= 0).alias("timed"),
    )


def _two_versions(spark: SparkSession, sf_dir: str) -> registry.Registry:
    """Two versions of a fitted model, the first one in production."""
    train, _ = _split_documents(spark, sf_dir)
    model, reg = _fitted(train), registry.Registry(spark)
    for score in (0.5, 0.6):
        reg.save_model("linear", model, f"run-{score}", score, {"input": "input_text string"})
    reg.promote("linear", 1)
    return reg


@query
def serve_requests(spark, sf_dir):
    """All requests, scored by the model that production points at after a promotion."""
    reg = _two_versions(spark, sf_dir)
    reg.promote("linear", 2)
    envelopes, _ = serving.serve(fixtures.load_requests(spark, sf_dir), serving.ProductionModel(reg, "linear"))
    return _served(envelopes)


@query
def stream_serve(spark, sf_dir):
    """Requests of even conversations, a promotion, then the others: each is answered by the version of its time."""
    reg, path, out = _two_versions(spark, sf_dir), new_path(spark, "request-stream"), new_path(spark, "stream-serve")
    reqs = fixtures.load_requests(spark, sf_dir)
    even = F.split_part("request_id", F.lit("-"), F.lit(1)).cast("long") % 2 == 0
    production = serving.ProductionModel(reg, "linear")
    for part, version in ((even, 1), (~even, 2)):
        reg.promote("linear", version)
        reqs.filter(part).write.mode("append").json(path)
        stream = request_source.stream_requests(spark, path)
        streams.stream_serve(stream, production, out, f"{out}/checkpoint").awaitTermination()
    return _served(spark.read.parquet(f"{out}/responses").drop("batch_id"))


@query
def request_types(spark, sf_dir):
    """Bodies whose fields have other JSON types, or that are no JSON, among the sound ones."""
    path = new_path(spark, "request-bodies")
    fixtures.request_bodies(fixtures.table(spark, sf_dir, "conversations")).write.text(path)
    return requests.clean_requests(request_source.read_requests(spark, path))[1]


@query
def fold_frequencies(spark, sf_dir):
    """Document frequencies by fold, which give the vocabularies of all fits of the grid."""
    documents = _documents(spark, sf_dir)
    own = documents.select("row_id", "class", terms("input_text", 2).alias("terms"))
    folded = split.stratified_kfold(own, "class", "row_id", classifier.FOLDS, SEED)
    return classifier.fold_frequencies(stage(folded, "folds"), classifier.FOLDS).withColumn("words", F.col("words").cast("bigint"))


# --- registry --------------------------------------------------------------


@query
def model_save(spark, sf_dir):
    train, _ = _split_documents(spark, sf_dir)
    model = _fitted(train)
    reg = registry.Registry(spark)
    for score in (0.5, 0.6):
        reg.save_model("linear", model, f"run-{score}", score, {"input": "input_text string"})
    return reg.read("model_versions").select("name", "version", "run_id", "signature", "test_f1_score")


@query
def model_load(spark, sf_dir):
    train, test = _split_documents(spark, sf_dir)
    reg = registry.Registry(spark)
    version = reg.save_model("linear", _fitted(train), "run", 0.5, {"input": "input_text string"})
    reg.promote("linear", version)
    loaded = classifier.predict(reg.load_model("linear"), test)
    return loaded.select("row_id", "class", _known("prediction").alias("known"))


@query
def train_and_promote(spark, sf_dir):
    """The whole training job: prepare, search, evaluate, log, save, promote."""
    data = training.prepare_data(_raw(spark, sf_dir))
    reg = registry.Registry(spark)
    training.run_linear_training(data, reg, "linear", "grid", parallelism=PARALLELISM)
    training.run_encoder_evaluation(
        data, reg, "encoder", "encoder", "lexicon", encoder.lexicon_factory(LEXICON), max_length=None
    )
    return reg.read("aliases").join(reg.read("model_versions"), ["name", "version"]).select(
        "name", "alias", "version", _share("test_f1_score").alias("scored")
    )


@query
def assign_version(spark, sf_dir):
    return registry.assign_version(fixtures.load_runs(spark, sf_dir)).select(
        "name", "run_id", "version"
    )


@query
def promote(spark, sf_dir):
    return rounded(
        registry.promotion_history(fixtures.load_runs(spark, sf_dir)).select(
            "name", "run_id", "version", "test_f1_score", "best_before", "promoted"
        )
    )


def _alias_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Versions and production aliases as the run history leaves them."""
    history = stage(registry.promotion_history(fixtures.load_runs(spark, sf_dir)), "history")
    aliases = (
        history.filter("promoted")
        .groupBy("name")
        .agg(F.max("version").alias("version"))
        .withColumn("alias", F.lit(registry.PRODUCTION))
    )
    return history, aliases


@query
def promote_candidate(spark, sf_dir):
    """The last version of each name, offered against the production version."""
    versions, aliases = _alias_tables(spark, sf_dir)
    last = versions.groupBy("name").agg(F.max("version").alias("version"))
    candidates = versions.join(last, ["name", "version"])
    return registry.promote(versions, aliases, candidates)


@query
def production_meta(spark, sf_dir):
    versions, aliases = _alias_tables(spark, sf_dir)
    names = versions.select("name").distinct().unionByName(
        fixtures.table(spark, sf_dir, "documents").select(F.col("lang").alias("name")).distinct()
    )
    return registry.production_meta(names, aliases, versions)


@query
def run_name(spark, sf_dir):
    return registry.run_name(fixtures.load_runs(spark, sf_dir)).select("run_id", "run_name")


# --- streams ---------------------------------------------------------------


def _news_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(NEWS_RAW).parquet(_raw_path(spark, sf_dir))


@query
def stream_score(spark, sf_dir):
    table = _scoring_table(_documents(spark, sf_dir))
    path = new_path(spark, "request-stream")
    fixtures.load_requests(spark, sf_dir).repartition(4).write.json(path)
    out = new_path(spark, "stream-score")
    stream = request_source.stream_requests(spark, path, max_files=2)
    streams.stream_score(
        stream, lambda t: linear.score_texts(t, table, INTERCEPTS), out, f"{out}/checkpoint"
    ).awaitTermination()
    scored = spark.read.parquet(f"{out}/scores").drop("batch_id")
    return rounded(_flat_probabilities(scored))


@query
def stream_reject(spark, sf_dir):
    """The reject sink of the scoring stream."""
    path = new_path(spark, "request-stream")
    fixtures.load_requests(spark, sf_dir).repartition(4).write.json(path)
    out = new_path(spark, "stream-score")
    stream = request_source.stream_requests(spark, path, max_files=2)
    make = encoder.lexicon_factory(LEXICON)
    streams.stream_score(
        stream,
        lambda t: encoder.score_batches(t, make, max_length=None).drop("input_text"),
        out,
        f"{out}/checkpoint",
    ).awaitTermination()
    return spark.read.parquet(f"{out}/rejects").drop("batch_id")


@query
def stream_trend(spark, sf_dir):
    out = new_path(spark, "stream-trend")
    trend = streams.stream_trend(streams.stream_clean(_news_stream(spark, sf_dir)), "1 day")
    return streams.run_complete(trend, f"{out}/table", f"{out}/checkpoint")


@query
def stream_trend_late(spark, sf_dir):
    """Batches of few files, whose rows mix all days: each batch corrects buckets of those before it."""
    out = new_path(spark, "stream-trend-late")
    news = spark.readStream.schema(NEWS_RAW).option("maxFilesPerTrigger", 4).parquet(_raw_path(spark, sf_dir))
    trends.stream_trend_table(
        streams.stream_clean(news), f"{out}/table", f"{out}/checkpoint", compact_every=2
    ).awaitTermination()
    return trends.read_trend(spark, f"{out}/table")


@query
def stream_dedup(spark, sf_dir):
    out = new_path(spark, "stream-dedup")
    unique = streams.stream_dedup(streams.stream_clean(_news_stream(spark, sf_dir)), "400 days")
    return streams.run_to_table(unique, f"{out}/table", f"{out}/checkpoint").select(
        "title", "text", "class"
    )


@query
def stream_clean(spark, sf_dir):
    out = new_path(spark, "stream-clean")
    rows = streams.stream_clean(_news_stream(spark, sf_dir))
    return streams.run_to_table(rows, f"{out}/table", f"{out}/checkpoint")
