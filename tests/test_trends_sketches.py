from __future__ import annotations

import datetime as dt
import os

import pytest
from rows import rows_of

from tonegrain.operators import analytics, clean, profile
from tonegrain.schema import NEWS_RAW
from tonegrain.streaming import streams, trends

LABEL = "{'class': 'positive', 'polarity': 0.5, 'subjectivity': 0.5}"


def news(days, start=0):
    return [(start + i, f"{d} 01:00:00", LABEL, "src", "btc", f"t{start + i}", f"x{start + i}") for i, d in enumerate(days)]


@pytest.fixture
def late_files(spark, tmp_path):
    """Five batches; the later ones hold days long past."""
    path = str(tmp_path / "news")
    days = [["2024-05-01"] * 7, ["2024-05-02"] * 3, ["2021-01-01", "2024-05-01"], ["2021-01-01"], ["not a day"]]
    for i, part in enumerate(days):
        spark.createDataFrame(news(part, 100 * i), NEWS_RAW).coalesce(1).write.mode("append").parquet(path)
    return path


def want_of(spark, path):
    return rows_of(analytics.trend(clean.filter_news(spark.read.parquet(path))), "bucket", "class", "n_rows")


@pytest.mark.parametrize("compact_every", [1, 2, 100])
def test_late_rows_correct_their_buckets(spark, tmp_path, late_files, compact_every):
    out = str(tmp_path / "out")
    stream = spark.readStream.schema(NEWS_RAW).option("maxFilesPerTrigger", 1).parquet(late_files)
    cleaned = streams.stream_clean(stream)
    trends.stream_trend_table(cleaned, f"{out}/t", f"{out}/c", compact_every=compact_every).awaitTermination()
    assert rows_of(trends.read_trend(spark, f"{out}/t")) == want_of(spark, late_files)
    # At most the batches of two bases are kept.
    kept = [f for f in os.listdir(f"{out}/t") if f.startswith("batch=")]
    assert len(kept) <= min(5, 2 * compact_every)


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    out = str(tmp_path / "t")
    first, second = (streams.stream_clean(spark.createDataFrame(news(d, s), NEWS_RAW)) for d, s in ((["2024-01-01"] * 4, 0), (["2024-01-01", "2023-01-01"], 50)))
    trends.add_batch(first, 0, out)
    trends.add_batch(second, 1, out)
    want = [(dt.date(2023, 1, 1), "positive", 1), (dt.date(2024, 1, 1), "positive", 5)]
    trends.add_batch(second, 1, out)
    assert rows_of(trends.read_trend(spark, out)) == want
    trends.compact(spark, out, 1)
    # The batch ended, its base was written, the stream had not noted it yet.
    trends.add_batch(second, 1, out)
    trends.compact(spark, out, 1)
    assert rows_of(trends.read_trend(spark, out)) == want


def test_unfinished_folders_are_not_read(spark, tmp_path):
    out = str(tmp_path / "t")
    assert trends.read_trend(spark, out).collect() == []
    rows = streams.stream_clean(spark.createDataFrame(news(["2024-01-01"] * 4), NEWS_RAW))
    for i in (0, 1):
        trends.add_batch(rows, i, out)
    os.remove(f"{out}/batch=1/_SUCCESS")
    assert rows_of(trends.read_trend(spark, out), "n_rows") == [(4,)]


def test_merged_sketches_keep_their_rank_error(make):
    start = dt.datetime(2023, 1, 5)
    rows = [("hot" if i % 3 else f"g{i % 4}", start + dt.timedelta(days=i % 400), (i * 7919) % 5003) for i in range(20_000)]
    rows += [(None, start, 5), ("hot", None, 17), ("empty", start, None), ("one", start, 3), ("same", start, 9), ("same", start, 9)]
    df = make(rows, "g string, date timestamp, v bigint")
    sketches = profile.quantile_sketches(df, "g", "v")
    assert sketches.filter("g = 'hot'").count() == 15  # 14 months and the row without a date
    merged = profile.merged_quantiles(sketches, "g")
    errors = {r["g"]: r for r in profile.rank_errors(df.filter("v IS NOT NULL"), merged, "g", "v").collect()}
    assert set(errors) == {"hot", "g0", "g1", "g2", "g3", "one", "same"}
    for g, r in errors.items():
        assert r["n_rows"] == sum(row[0] == g and row[2] is not None for row in rows)
        assert max(r["p25_error"], r["p50_error"], r["p75_error"]) <= 2 * profile.sketch_rank_error()
    small = {r["g"]: r for r in merged.collect()}
    assert [small["one"][p] for p in ("p25", "p50", "p75")] == [3, 3, 3]
    assert small["same"]["p50"] == 9


def test_a_span_of_periods_needs_only_their_sketches(make):
    rows = [("a", dt.datetime(2024, m, 1), m * 100 + i) for m in range(1, 7) for i in range(50)]
    sketches = profile.quantile_sketches(make(rows, "g string, date timestamp, v bigint"), "g", "v")
    half = profile.merged_quantiles(sketches.filter("period <= '2024-03-31'"), "g").first()
    assert half["n_rows"] == 150 and 200 <= half["p50"] < 250


def test_no_rows_give_no_sketches(make):
    df = make([], "g string, date timestamp, v bigint")
    assert profile.merged_quantiles(profile.quantile_sketches(df, "g", "v"), "g").collect() == []
