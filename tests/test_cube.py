"""The stored cube against the same queries on rows."""

from __future__ import annotations

import datetime as dt

import pytest
from rows import rows_of

from tonegrain.operators import analytics, cube
from tonegrain.sources import news

SCHEMA = "row_id bigint, date timestamp, source string, subject string, class string, polarity double, subjectivity double"


def load(n, months, shift=0):
    classes = ("positive", "neutral", "negative")
    return [
        (i, dt.datetime(2024, months[i % len(months)], 1 + i % 28, i % 24, 59), None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 7}",
         f"c{i % 4}", classes[(i + shift) % 3], None if i % 5 == 0 or i % 28 == 3 else i / 64, None if i % 6 == 0 else -i / 32)
        for i in range(n)
    ]


def stored(spark, make, path, rows):
    news.write_clean(make(rows, SCHEMA), path)
    return news.read_clean(spark, path)


def assert_same(lines, rows):
    for grain in analytics.GRAINS:
        for measure in ("count", "share", "polarity", "subjectivity"):
            got, want = cube.trend(lines, grain, measure), analytics.trend(rows, grain, measure)
            assert got.columns == want.columns
            for g, w in zip(rows_of(got), rows_of(want), strict=True):
                assert g[:-1] == w[:-1] and g[-1] == (w[-1] if w[-1] is None else pytest.approx(w[-1]))
    for by in ("source", "subject"):
        assert rows_of(cube.breakdown(lines, by)) == rows_of(analytics.breakdown(rows, by))
    assert rows_of(cube.breakdown_sets(lines)) == rows_of(analytics.breakdown_sets(rows))


def test_cube_answers_as_the_rows_do(spark, make, tmp_path):
    rows = stored(spark, make, str(tmp_path / "clean"), load(500, (1, 2, 5)))
    path = str(tmp_path / "cube")
    cube.refresh(spark, rows, path)
    lines = cube.read_cube(spark, path)
    assert_same(lines, rows)
    days = (dt.date(2024, 1, 9), dt.date(2024, 5, 3), ["hot", "s1"], ["c1", "c2"])
    assert_same(analytics.dashboard_filter(lines, *days), analytics.dashboard_filter(rows, *days))
    plan = analytics.dashboard_filter(lines, *days)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_a_load_rewrites_its_months_only(spark, make, tmp_path):
    path = str(tmp_path / "cube")
    before = stored(spark, make, str(tmp_path / "a"), load(300, (1, 2, 3)))
    cube.refresh(spark, before, path)
    kept = {f: f.stat().st_mtime_ns for m in (1, 2) for f in (tmp_path / "cube" / f"month=2024-0{m}-01").iterdir()}
    # March changes, April comes, and February's rows went without the load saying so.
    after = stored(spark, make, str(tmp_path / "b"), load(300, (1, 3, 4), shift=1))
    months = [dt.date(2024, 3, 9), dt.date(2024, 4, 1)]
    cube.refresh(spark, after, path, months)
    assert all(f.stat().st_mtime_ns == t for f, t in kept.items())
    want = before.filter("month < '2024-03-01'").union(after.filter("month >= '2024-03-01'"))
    assert_same(cube.read_cube(spark, path), want)
    cube.refresh(spark, after, path, months)  # a replay
    assert_same(cube.read_cube(spark, path), want)
    cube.refresh(spark, after, path, [])
    assert_same(cube.read_cube(spark, path), want)
    # A month whose rows are gone is empty, not left over.
    cube.refresh(spark, after, path, [dt.date(2024, 2, 1)])
    assert_same(cube.read_cube(spark, path), want.filter("month <> '2024-02-01'"))


def test_only_named_months_are_scanned(spark, make, tmp_path):
    rows = stored(spark, make, str(tmp_path / "clean"), load(90, (1, 2, 3)))
    one = rows.filter(rows["month"].isin([dt.date(2024, 2, 1)]))
    assert cube.months_of(rows) == [dt.date(2024, m, 1) for m in (1, 2, 3)]
    scan = cube.cube(one)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in scan or "PartitionFilters: [month" in scan


def test_empty_table_and_unknown_measure(spark, make, tmp_path):
    lines = cube.cube(make([], SCHEMA))
    assert cube.trend(lines).count() == 0 and cube.breakdown(lines, "source").count() == 0
    assert cube.months_of(make([], SCHEMA)) == []
    with pytest.raises(ValueError, match="measure"):
        cube.trend(lines, "day", "median")
