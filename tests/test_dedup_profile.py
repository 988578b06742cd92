from __future__ import annotations

import datetime as dt
import statistics
from collections import Counter

import numpy as np
import pytest
from rows import rows_of

from tonegrain.functions.digest import row_digest
from tonegrain.operators import analytics, dedup, profile
from tonegrain.schema import DEDUP_KEYS
from tonegrain.sources import news

SCHEMA = "row_id bigint, date timestamp, text string, title string, class string"
DAY = dt.datetime(2024, 1, 1)

ROWS = [
    (1, DAY, "a", None, "positive"),
    (2, DAY, "a", None, "positive"),
    (3, None, "a", None, "positive"),
    (4, DAY - dt.timedelta(days=1), None, "a", "positive"),
    (5, None, None, "a", "positive"),
    (6, DAY, None, None, None),
    (7, DAY, None, None, None),
    (8, DAY, "b", "c", "neutral"),
]


def heavy(n=3000):
    """One text makes up most of the table."""
    return [
        (i, DAY + dt.timedelta(minutes=(i * 37) % 1000), "hot" if i % 4 else f"t{i % 50}", None, "neutral")
        for i in range(n)
    ]


def first_of_each(rows, keys):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    best = {}
    for r in rows:
        record = dict(zip(names, r, strict=True))
        key = tuple(record[k] for k in keys)
        order = (record["date"] is None, record["date"] or DAY, record["row_id"])
        if key not in best or order < best[key][0]:
            best[key] = (order, record["row_id"])
    return {v[1] for v in best.values()}


@pytest.mark.parametrize("rows", [ROWS, heavy()])
def test_dedup_keeps_the_earliest_and_lists_the_rest(make, rows):
    df = make(rows, SCHEMA)
    want = first_of_each(rows, DEDUP_KEYS)
    assert {r[0] for r in rows_of(dedup.dedup_keep_first(df), "row_id")} == want
    removed = {r[0] for r in rows_of(dedup.removed_rows(df), "row_id")}
    assert removed == {r[0] for r in rows} - want


def test_digest_tells_null_empty_and_shifted_values_apart(make):
    rows = [(None, ""), ("", None), (None, None), ("", ""), ("-", None), ("a", "b"), ("a1:", "b"), ("ab", "")]
    df = make(rows, "a string, b string").select(row_digest("a", "b").alias("d"))
    assert df.distinct().count() == len(rows)


@pytest.mark.parametrize("keys", [["text"], ["title"], ["text", "title"]])
@pytest.mark.parametrize("rows", [ROWS, heavy(800)])
@pytest.mark.parametrize("heavy_share", [100_000, 10])
def test_duplicate_rows_match_a_count(make, rows, keys, heavy_share, monkeypatch):
    monkeypatch.setattr(dedup, "HEAVY_SHARE", heavy_share)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    key = lambda r: tuple(dict(zip(names, r, strict=True))[k] for k in keys)
    counts = Counter(map(key, rows))
    want = {r[0] for r in rows if counts[key(r)] > 1}
    got = dedup.duplicate_rows(make(rows, SCHEMA), keys)
    assert {r[0] for r in rows_of(got, "row_id")} == want
    ordered = [(r[keys[0]] is None, r[keys[0]] or "") for r in got.collect()]
    assert ordered == sorted(ordered)


def test_dup_ratio_counts_nulls_as_one_value(make):
    got = dedup.dup_ratio(make(ROWS, SCHEMA), "text").first()
    assert (got["n_rows"], got["n_repeats"]) == (8, 5)
    assert got["dup_ratio"] == pytest.approx(5 / 8)


def test_class_counts_ratios_and_flags(make):
    df = make(ROWS, SCHEMA)
    assert [tuple(r) for r in profile.class_count(df).collect()] == [("positive", 5), ("neutral", 1)]
    ratios = {r["class"]: r["ratio"] for r in profile.class_ratio(df).collect()}
    assert sum(ratios.values()) == pytest.approx(1)
    flags = profile.null_flags(df, ["row_id", "date", "text"]).first()
    assert tuple(flags) == (False, True, True)
    assert tuple(profile.date_range(df).first()) == (DAY - dt.timedelta(days=1), DAY)


def test_empty_table_has_no_nulls(make):
    df = make(ROWS, SCHEMA).filter("row_id < 0")
    assert tuple(profile.null_flags(df, ["text"]).first()) == (False,)
    assert profile.class_ratio(df).count() == 0


def test_table_profile_and_head(make):
    df = make(ROWS, SCHEMA)
    got = {r["column_name"]: (r["column_type"], r["non_null"], r["n_rows"]) for r in profile.table_profile(df).collect()}
    assert got["text"] == ("string", 4, 8)
    assert got["date"] == ("timestamp", 6, 8)
    assert [r["row_id"] for r in profile.head_rows(df, 3).collect()] == [1, 2, 3]


def test_distinct_values_hold_null_and_sort_it_last(make):
    df = make([(0.5,), (None,), (-1.0,), (0.5,)], "polarity double")
    assert [r[0] for r in profile.distinct_sorted(df, "polarity").collect()] == [-1.0, 0.5, None]


def test_text_lengths_match_numpy(make):
    rng = np.random.default_rng(5)
    rows = [("ab"[i % 2], "é" * int(n)) for i, n in enumerate(rng.integers(0, 60, 500))]
    rows += [("one", "xyz"), (None, "q"), ("a", None)]
    got = {r["class"]: r for r in profile.text_len_by_class(make(rows, "class string, text string")).collect()}
    assert set(got) == {"a", "b", "one"}
    for name in "ab":
        lengths = [len(t) for c, t in rows if c == name and t is not None]
        r = got[name]
        assert r["n_rows"] == len(lengths)
        assert r["mean"] == pytest.approx(statistics.fmean(lengths))
        assert r["std"] == pytest.approx(statistics.stdev(lengths))
        assert [r["p25"], r["p50"], r["p75"]] == pytest.approx(list(np.percentile(lengths, [25, 50, 75])))
        assert (r["min"], r["max"]) == (min(lengths), max(lengths))
    assert got["one"]["std"] is None


def test_latencies_are_described_in_whole_milliseconds(make):
    df = make([("a", v) for v in (7.9, 8.9, 8.4)], "g string, v double")
    got = profile.describe_by(df, "g", "v").first()
    assert (got["min"], got["p50"], got["max"]) == (8, 8.0, 9)


NEWS = "row_id bigint, date timestamp, source string, subject string, class string, polarity double"


def some_news(n=400):
    classes = ("negative", "neutral", "positive")
    return [
        (
            i, DAY + dt.timedelta(hours=(i * 53) % 9000), "hot" if i % 3 else f"s{i % 7}", f"c{i % 4}",
            classes[(i * i) % 3], None if i % 11 == 0 else i / 100,
        )
        for i in range(n)
    ]


@pytest.mark.parametrize("grain", analytics.GRAINS)
def test_trend_counts_add_up(make, grain):
    rows = some_news()
    got = analytics.trend(make(rows, NEWS), grain).collect()
    assert sum(r["n_rows"] for r in got) == len(rows)
    if grain == "week":
        assert {r["bucket"].weekday() for r in got} == {0}
    shares = Counter()
    for r in analytics.trend(make(rows, NEWS), grain, "share").collect():
        shares[r["bucket"]] += r["share"]
    assert all(v == pytest.approx(1) for v in shares.values())


def test_trend_mean_skips_nulls_and_rejects_unknown_arguments(make):
    df = make([(1, DAY, "s", "c", "neutral", None), (2, DAY, "s", "c", "neutral", 0.5)], NEWS)
    assert analytics.trend(df, "day", "polarity").first()["mean_polarity"] == 0.5
    with pytest.raises(ValueError):
        analytics.trend(df, "hour")
    with pytest.raises(ValueError):
        analytics.trend(df, "day", "median")


def test_filled_trend_has_every_bucket_for_every_class(make):
    rows = [
        (1, DAY, "s", "c", "neutral", 0.0),
        (2, DAY + dt.timedelta(days=3), "s", "c", "positive", 0.0),
    ]
    filled = analytics.fill_buckets(analytics.trend(make(rows, NEWS)))
    assert filled.count() == 8
    assert sum(r["n_rows"] for r in filled.collect()) == 2


def test_dashboard_filter_includes_both_days(make):
    df = make(some_news(), NEWS)
    start, end = dt.date(2024, 1, 3), dt.date(2024, 1, 9)
    got = analytics.dashboard_filter(df, start, end, ["hot"], ["c1", "c2"])
    want = {
        r[0] for r in some_news()
        if start <= r[1].date() <= end and r[2] == "hot" and r[3] in ("c1", "c2")
    }
    assert want and {r[0] for r in rows_of(got, "row_id")} == want


def test_stored_table_prunes_months(spark, make, tmp_path):
    path = str(tmp_path / "clean")
    news.write_clean(make(some_news(), NEWS), path)
    stored = news.read_clean(spark, path)
    start, end = dt.date(2024, 3, 5), dt.date(2024, 4, 9)
    got = analytics.dashboard_filter(stored, start, end)
    want = {r[0] for r in some_news() if start <= r[1].date() <= end}
    assert {r[0] for r in rows_of(got, "row_id")} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    assert "GreaterThanOrEqual(date" in plan


def test_latest_per_group_matches_a_sort(make):
    rows = some_news()
    got = rows_of(analytics.latest_per_group(make(rows, NEWS), "source", 5), "source", "row_id", "rank")
    want = []
    for source in {r[2] for r in rows}:
        newest = sorted((r for r in rows if r[2] == source), key=lambda r: (-r[1].timestamp(), r[0]))
        want += [(source, r[0], i + 1) for i, r in enumerate(newest[:5])]
    assert got == sorted(want, key=repr)
    one = [r["row_id"] for r in analytics.latest(make(rows, NEWS), "source", "hot", 5).collect()]
    assert one == [w[1] for w in sorted((w for w in want if w[0] == "hot"), key=lambda w: w[2])]


def test_breakdowns(make):
    df = make(some_news(), NEWS)
    sets = analytics.breakdown_sets(df).collect()
    assert Counter(r["grouping_set"] for r in sets).keys() == {2, 4, 6}
    for r in analytics.breakdown(df, "source").collect():
        twin = [s for s in sets if s["grouping_set"] == 2 and s["source"] == r["source"] and s["class"] == r["class"]]
        assert twin[0]["n_rows"] == r["n_rows"]


def test_model_comparison_joins_by_row(make):
    a = make([(1, "positive", "positive"), (2, "neutral", "positive")], "row_id bigint, class string, prediction string")
    b = make([(1, "positive"), (2, "neutral")], "row_id bigint, prediction string")
    compared = analytics.compare(a, b)
    assert rows_of(compared, "row_id", "is_match") == [(1, True), (2, False)]
    assert dict(rows_of(analytics.match_rate(compared), "class", "match_rate")) == {
        "positive": 1.0, "neutral": 0.0, "all": 0.5,
    }


def test_latency_summary(make):
    df = make([("a", i) for i in range(1, 101)], "model string, latency_ms int")
    got = analytics.latency_summary(df).first()
    assert (got["n_rows"], got["mean"], got["p50"]) == (100, 50.5, 50.5)
