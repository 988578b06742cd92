from __future__ import annotations

import pytest
from rows import rows_of
from pyspark.errors import AnalysisException

from tonegrain.operators.clean import clean_table
from tonegrain.schema import NA_TOKENS, NEWS_RAW
from tonegrain.sources import news, requests, staging

RAW = NEWS_RAW.simpleString()


def test_missing_tokens_become_null_and_lookalikes_stay(make):
    values = [*NA_TOKENS, " NA", "na", "x"]
    df = make([(i, v) for i, v in enumerate(values)], "row_id bigint, text string")
    kept = {r["text"] for r in news.na_normalise(df).collect() if r["text"] is not None}
    assert kept == {" NA", "na", "x"}
    assert len(NA_TOKENS) == 19


def test_csv_round_trip_keeps_quotes_lines_and_spaces(spark, make, tmp_path):
    rows = [
        (1, "2021-11-05 04:42:00", "{'class': 'positive'}", "a", "b", 'say "hi", now', "two\nlines"),
        (2, "x", None, None, "b", "  spaced  ", "back\\slash"),
        (3, "NaN", "null", "N/A", "", "crlf\r\nkept", 'ends with "'),
    ]
    df = make(rows, RAW)
    path = str(tmp_path / "csv")
    news.write_news_csv(df, path)
    got = rows_of(news.read_news(spark, path))
    want = [list(r) for r in rows]
    want[2][1:5] = [None] * 4
    assert got == sorted(map(tuple, want), key=repr)
    again = news.news_to_parquet(spark, path, str(tmp_path / "parquet"))
    assert rows_of(again) == got


def test_csv_columns_are_found_by_name(spark, tmp_path):
    head = "source,url,text,date,sentiment,title,subject\n"
    (tmp_path / "news.csv").write_text(
        head + "src,u,\"a body,\nof two lines\",2021-11-05 04:42:00,"
        "\"{'class': 'positive', 'polarity': 0.5, 'subjectivity': 0.1}\",A title,btc\n"
        "src,u,body,2021-11-05 05:42:00,\"{'class': 'neutral', 'polarity': 0, 'subjectivity': 0}\",,btc\n"
        "too,few\n"
    )
    raw = news.read_news(spark, str(tmp_path))
    assert raw.columns == NEWS_RAW.names
    got = rows_of(clean_table(raw), "source", "title", "text", "class", "polarity")
    assert got == [("src", "A title", "a body,\nof two lines", "positive", 0.5), ("src", None, "body", "neutral", 0.0)]
    assert raw.select("row_id").distinct().count() == 3
    broken = news.read_news(spark, str(tmp_path), keep_corrupt=True).filter("_corrupt_record is not null")
    assert rows_of(broken, "source", "_corrupt_record") == [("too", "too,few")]


def test_csv_without_a_needed_column_is_an_error(spark, tmp_path):
    (tmp_path / "news.csv").write_text("date,sentiment,source,subject,title\n")
    with pytest.raises(ValueError, match="text"):
        news.read_news(spark, str(tmp_path))


def test_load_stats_counts_rows_and_columns(make):
    df = make([(1, "a"), (2, "b")], "row_id bigint, text string")
    assert rows_of(news.load_stats(df)) == [(2, 2)]


def test_missing_input_fails_at_once(spark):
    with pytest.raises(AnalysisException):
        news.read_news(spark, "/nowhere/news.csv")


def test_shared_root_follows_the_session(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    assert before is None or staging.shared_root(spark) == before.rstrip("/")


def test_requests_read_from_json_lines(spark, tmp_path):
    path = tmp_path / "requests"
    path.mkdir()
    (path / "a.json").write_text(
        '{"request_id": "1", "input_text": "up"}\n'
        '{"request_id": "2", "input_texts": ["up", "down"]}\n'
        "not json\n"
    )
    df = requests.read_requests(spark, str(path))
    assert rows_of(df.filter("_corrupt_record is null"), "request_id", "input_text", "input_texts") == [
        ("1", "up", None),
        ("2", None, ["up", "down"]),
    ]
    broken = df.filter("_corrupt_record is not null")
    assert rows_of(broken, "request_id", "_corrupt_record") == [(None, "not json")]
