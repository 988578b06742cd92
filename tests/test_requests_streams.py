from __future__ import annotations

import datetime as dt
import json

import pytest
from rows import rows_of
from pyspark.errors import StreamingQueryException
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from tonegrain.operators import analytics, classifier, clean, dedup, registry, requests, serving
from tonegrain.schema import CLASSES, NEWS_RAW
from tonegrain.sources import requests as request_source
from tonegrain.streaming import streams

REQUEST = "request_id string, input_text string, input_texts array<string>"
ROWS = [
    ("1", " up ", None),
    ("2", None, ["a", "  ", None, " b "]),
    ("3", None, None),
    ("4", "   ", ["ignored"]),  # the single text wins even if it is blank
    ("5", "", None),
    ("6", "up", ["ignored"]),
    ("7", None, []),
]


def word_scorer(texts):
    return texts.select(
        "row_id", F.when(F.col("input_text") == "up", "positive").otherwise("neutral").alias("sentiment")
    )


def failing_scorer(texts):
    return texts.select("row_id", F.raise_error(F.lit("no model")).cast("string").alias("sentiment"))


def test_items_and_errors(make):
    items, errors = requests.clean_requests(make(ROWS, REQUEST))
    assert rows_of(items) == [("1", 0, "up"), ("2", 0, "a"), ("2", 1, "b"), ("6", 0, "up")]
    assert rows_of(errors, "request_id", "status") == [("3", 400), ("4", 400), ("5", 422), ("7", 400)]
    assert {r[0] for r in rows_of(errors, "error")} == {"request_failed"}


def test_scored_requests_keep_position_and_form_responses(make, tmp_path, spark):
    rows = [*ROWS, ("a#b", None, ["x", "up"]), ("8", None, [f"t{i}" for i in range(12)])]
    scored = requests.score_requests(make(rows, REQUEST), word_scorer)
    assert ("a#b", 1, "positive") in rows_of(scored, "request_id", "pos", "sentiment")
    meta = spark.range(1).select(F.lit("m").alias("name"), F.lit(3).alias("version"))
    timed = scored.withColumn("latency_ms", F.lit(7.9))
    envelopes = requests.responses(timed, "models:/m@production", meta)
    path = str(tmp_path / "out")
    request_source.write_responses(envelopes, path)
    got = {r["request_id"]: json.loads(r.asDict()["j"]) for r in spark.read.json(path).select("request_id", F.to_json(F.struct("*")).alias("j")).collect()}
    assert [p["pos"] for p in got["8"]["predictions"]] == list(range(12))
    assert got["1"]["predictions"][0]["sentiment"] == "positive"
    assert got["1"]["model_uri"] == "models:/m@production"
    assert got["1"]["latency_ms"] == 8
    assert got["1"]["meta"] == {"name": "m", "version": "3"}


def test_requests_of_one_id_stay_apart_and_none_is_rejected(make):
    rows = [("1", None, ["up", "up"]), ("1", "down", None), (None, "up", None)]
    scored = requests.score_requests(make(rows, REQUEST), word_scorer)
    with_map = scored.withColumn("probabilities", F.create_map(F.lit("positive"), F.lit(1.0)))
    got = sorted([p["sentiment"] for p in r["predictions"]] for r in requests.responses(with_map, "m").collect())
    assert got == [["neutral"], ["positive", "positive"]]
    assert rows_of(requests.request_validate(make(rows, REQUEST)), "request_id", "status") == [(None, 422)]


BODIES = [
    ('{"request_id":"1","input_text":7}', "1", request_source.TEXT_TYPE),
    ('{"request_id":"2","input_texts":["a",5]}', "2", request_source.TEXTS_TYPE),
    ('{"request_id":"3","input_texts":"a"}', "3", request_source.TEXTS_TYPE),
    ('{"request_id":"4","input_text":["a"]}', "4", request_source.TEXT_TYPE),
    ('{"request_id":"5","input_text":{"a":1}}', "5", request_source.TEXT_TYPE),
    ('["a"]', None, request_source.NOT_AN_OBJECT),
    ("null", None, request_source.NOT_AN_OBJECT),
    ('{"request_id":"6","input_text":"a"', None, "body is not valid JSON"),
    ('{"request_id":"7","input_text":""}', "7", "input_text must have at least 1 character"),
    ('{"input_text":"a"}', None, "request_id is missing"),
    ('{"request_id":"8","input_text":true}', "8", request_source.TEXT_TYPE),
    ('{"request_id":"9","input_texts":[["a"]]}', "9", request_source.TEXTS_TYPE),
]
SOUND = ['{"request_id":10,"input_text":" 7 ","more":{"x":[1]}}', '{"request_id":"11","input_text":null,"input_texts":["a",null,"b"]}', "", "  "]


def test_json_types_are_seen_before_the_cast(spark, tmp_path):
    write_json(tmp_path / "in", [[b for b, *_ in BODIES], SOUND])
    got = request_source.read_requests(spark, str(tmp_path / "in"))
    items, errors = requests.clean_requests(got)
    assert rows_of(errors, "request_id", "detail") == sorted(((i, d) for _, i, d in BODIES), key=repr)
    assert {r[0] for r in rows_of(errors, "status")} == {422}
    assert rows_of(items) == [("10", 0, "7"), ("11", 0, "a"), ("11", 1, "b")]


class Promoting(serving.ProductionModel):
    """Promotes the second version once the first batch has been answered."""

    batches = 0

    def refresh(self):
        self.batches += 1
        if self.batches == 2:
            self.registry.promote(self.name, 2)
        return super().refresh()


def test_a_promotion_between_two_batches_counts_from_the_next(spark, tmp_path):
    train = spark.createDataFrame([(i, f"{c} word{i % 3} text", c) for i, c in enumerate(CLASSES * 6)], "row_id long, input_text string, class string")
    model = classifier.fit_classifier(train, 1, 1, 1.0, 3)
    reg = registry.Registry(spark, str(tmp_path / "registry"))
    lines = [[json.dumps({"request_id": f"{f}-{i}", "input_texts": ["positive", "negative text"][: 1 + i % 2]}) for i in range(4)] for f in range(3)]
    write_json(tmp_path / "in", lines)
    out, production = str(tmp_path / "out"), Promoting(reg, "m")

    def run(to):
        stream = request_source.stream_requests(spark, str(tmp_path / "in"), max_files=1)
        streams.stream_serve(stream, production, to, f"{to}/checkpoint").awaitTermination()

    envelopes, errors = serving.serve(request_source.read_requests(spark, str(tmp_path / "in")), serving.ProductionModel(reg, "m"))
    assert envelopes is None and {r[0] for r in rows_of(errors, "status")} == {503} and errors.count() == 12
    for score in (0.1, 0.2):
        reg.save_model("m", model, f"run{score}", score, {})
    reg.promote("m", 1)
    run(out)
    got = spark.read.parquet(f"{out}/responses").select("batch_id", "request_id", F.col("meta")["version"].alias("v"), F.col("meta")["run_id"].alias("run"), "model_uri", "predictions", "latency_ms")
    by_batch = {r["batch_id"]: (r["v"], r["run"]) for r in got.collect()}
    assert by_batch == {0: ("1", "run0.1"), 1: ("2", "run0.2"), 2: ("2", "run0.2")} and got.count() == 12
    for r in got.collect():
        assert r["model_uri"] == "models:/m@production" and r["latency_ms"] >= 0
        assert [p["pos"] for p in r["predictions"]] == list(range(1 + int(r["request_id"][-1]) % 2))
        assert r["predictions"][0]["sentiment"] == "positive" and sum(r["predictions"][0]["probabilities"].values()) == pytest.approx(1)
    assert spark.read.parquet(f"{out}/rejects").count() == 0


def test_a_version_is_loaded_once(spark, tmp_path, monkeypatch):
    reg = registry.Registry(spark, str(tmp_path / "registry"))
    note = PipelineModel([SQLTransformer(statement="SELECT * FROM __THIS__")])
    for _ in range(2):
        reg.save_model("m", note, "r", 0.5, {})
    reg.promote("m", 1)
    loads = []
    monkeypatch.setattr(serving.PipelineModel, "load", lambda path: loads.append(path) or note)
    production = serving.ProductionModel(reg, "m")
    assert [production.refresh().version for _ in range(3)] == [1, 1, 1] and len(loads) == 1


def broken_storage(texts):
    raise OSError("disk full")


def odd_labels(texts):
    return texts.select("row_id", F.when(F.col("input_text") == "a", "LABEL_9").otherwise("neutral").alias("sentiment"))


def test_stream_answers_500_for_unknown_labels_and_fails_when_storage_does(spark, tmp_path, request_files):
    out = str(tmp_path / "out")
    stream = request_source.stream_requests(spark, request_files)
    streams.stream_score(stream, odd_labels, out, f"{out}/checkpoint").awaitTermination()
    status = dict(rows_of(spark.read.parquet(f"{out}/rejects").na.drop(), "request_id", "status"))
    assert status["2"] == 500 and "1" not in status
    assert {r[0] for r in rows_of(spark.read.parquet(f"{out}/scores"), "request_id")} == {"1", "6"}
    query = streams.stream_score(request_source.stream_requests(spark, request_files), broken_storage, f"{out}2", f"{out}2/checkpoint")
    with pytest.raises(StreamingQueryException):
        query.awaitTermination()


def test_unknown_labels_fail_the_whole_request(make):
    rows = [("1", 0, "positive"), ("1", 1, "LABEL_0"), ("2", 0, "neutral"), ("3", 0, None)]
    good, errors = requests.check_labels(make(rows, "request_id string, pos int, sentiment string"))
    assert rows_of(good) == [("2", 0, "neutral")]
    assert rows_of(errors, "request_id", "status") == [("1", 500), ("3", 500)]


def write_json(path, lines):
    path.mkdir()
    for i, part in enumerate(lines):
        (path / f"{i}.json").write_text("\n".join(part) + "\n")


@pytest.fixture
def request_files(tmp_path):
    lines = [json.dumps({k: v for k, v in zip(("request_id", "input_text", "input_texts"), r, strict=True) if v is not None}) for r in ROWS]
    write_json(tmp_path / "in", [lines[:3], lines[3:], ["broken"]])
    return str(tmp_path / "in")


def test_stream_scores_equal_batch_scores(spark, make, tmp_path, request_files):
    out = str(tmp_path / "out")
    stream = request_source.stream_requests(spark, request_files, max_files=1)
    streams.stream_score(stream, word_scorer, out, f"{out}/checkpoint").awaitTermination()
    batch = requests.score_requests(make(ROWS, REQUEST), word_scorer)
    columns = ("request_id", "pos", "sentiment")
    assert rows_of(spark.read.parquet(f"{out}/scores"), *columns) == rows_of(batch, *columns)
    rejects = rows_of(spark.read.parquet(f"{out}/rejects"), "request_id", "status")
    assert rejects == [("3", 400), ("4", 400), ("5", 422), ("7", 400), (None, 422)]


def test_stream_answers_503_when_the_model_fails(spark, tmp_path, request_files):
    out = str(tmp_path / "out")
    stream = request_source.stream_requests(spark, request_files)
    streams.stream_score(stream, failing_scorer, out, f"{out}/checkpoint").awaitTermination()
    status = dict(rows_of(spark.read.parquet(f"{out}/rejects").na.drop(), "request_id", "status"))
    assert status == {"1": 503, "2": 503, "6": 503, "3": 400, "4": 400, "7": 400, "5": 422}


def news_rows():
    label = "{'class': 'positive', 'polarity': 0.5, 'subjectivity': 0.5}"
    rows = []
    for i in range(60):
        day = dt.date(2024, 1, 1) + dt.timedelta(days=i // 6)
        rows.append((i, f"{day} 0{i % 6}:00:00", label, "src", "btc", f"t{i % 50}", f"x{i % 50}"))
    return rows


@pytest.fixture
def news_files(spark, tmp_path):
    """Three files, read one per batch in order of their names' times."""
    path = str(tmp_path / "news")
    rows = news_rows()
    for part in (rows[:20], rows[20:40], rows[40:]):
        spark.createDataFrame(part, NEWS_RAW).coalesce(1).write.mode("append").parquet(path)
    return path


def stream_of(spark, path):
    return spark.readStream.schema(NEWS_RAW).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_cleaning_equals_batch(spark, tmp_path, news_files):
    out = str(tmp_path / "out")
    got = streams.run_to_table(streams.stream_clean(stream_of(spark, news_files)), f"{out}/t", f"{out}/c")
    assert rows_of(got) == rows_of(clean.finish_news(clean.filter_news(spark.read.parquet(news_files))))


def test_complete_stream_trend_equals_batch(spark, tmp_path, news_files):
    out = str(tmp_path / "out")
    trend = streams.stream_trend(streams.stream_clean(stream_of(spark, news_files)), "1 day")
    got = streams.run_complete(trend, f"{out}/t", f"{out}/c")
    want = analytics.trend(clean.filter_news(spark.read.parquet(news_files)))
    assert rows_of(got, "bucket", "class", "n_rows") == rows_of(want, "bucket", "class", "n_rows")


def test_append_stream_trend_holds_back_open_windows_and_drops_late_rows(spark, tmp_path):
    path = str(tmp_path / "news")
    rows = news_rows()
    late = [(900, "2024-01-01 00:00:00", rows[0][2], "src", "btc", "late", "late")]
    for part in (rows[:48], rows[48:], late, [(901, "2024-01-20 00:00:00", rows[0][2], "src", "btc", "n", "n")]):
        spark.createDataFrame(part, NEWS_RAW).coalesce(1).write.mode("append").parquet(path)
    out = str(tmp_path / "out")
    trend = streams.stream_trend(streams.stream_clean(stream_of(spark, path)), "1 day")
    got = dict(rows_of(streams.run_to_table(trend, f"{out}/t", f"{out}/c"), "bucket", "n_rows"))
    assert got[dt.date(2024, 1, 1)] == 6  # without the late row
    assert dt.date(2024, 1, 20) not in got


def test_stream_dedup_keeps_one_of_each_key(spark, tmp_path, news_files):
    out = str(tmp_path / "out")
    cleaned = streams.stream_clean(stream_of(spark, news_files))
    got = streams.run_to_table(streams.stream_dedup(cleaned, "90 days"), f"{out}/t", f"{out}/c")
    batch = dedup.dedup_keep_first(clean.filter_news(spark.read.parquet(news_files)))
    assert rows_of(got, "title", "text", "class") == rows_of(batch, "title", "text", "class")


def test_stream_dedup_lets_a_key_in_again_after_its_bound(spark, tmp_path):
    label = "{'class': 'positive', 'polarity': 0.5, 'subjectivity': 0.5}"
    path = str(tmp_path / "news")
    keys = [f"k{i}" for i in range(12)]
    # Days 0, 8 and 16 of every key, by a bound of 10 days; other rows move the watermark on.
    for n, day in enumerate((1, 9, 22, 23, 17)):
        names = ["filler"] if day > 20 else keys
        part = [(100 * n + i, f"2024-01-{day:02d} 00:00:00", label, "s", "b", k, k) for i, k in enumerate(names)]
        spark.createDataFrame(part, NEWS_RAW).coalesce(1).write.mode("append").parquet(path)
    out = str(tmp_path / "out")
    unique = streams.stream_dedup(streams.stream_clean(stream_of(spark, path)), "10 days")
    got = rows_of(streams.run_to_table(unique, f"{out}/t", f"{out}/c"), "title", "date")
    for k in keys:
        assert [d.day for t, d in got if t == k] == [1, 17]
