"""Dashboard queries from a stored cube.

The cube holds, for each day, class, source and subject, what trends and breakdowns add
up: rows, and sum and number of the scores. It is partitioned by month like the clean
table it comes from. A load names the months it touched; only they are scanned and
written anew, so a replayed load changes nothing. Queries then read lines, not texts.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegrain.operators.analytics import _share_of, bucket

KEYS = ("month", "date", "class", "source", "subject")
# The measures of the dashboard.
MEASURES = ("polarity", "subjectivity")


def cube(df: DataFrame) -> DataFrame:
    """Additive lines per day, class, source and subject, in one aggregation; ``date`` is the day.

    A null score is left out of its sum and its number.
    """
    keyed = df.withColumns({"date": F.to_date("date"), "month": F.trunc("date", "month")})
    sums = [e for m in MEASURES for e in (F.sum(m).alias(f"sum_{m}"), F.count(m).alias(f"n_{m}"))]
    return keyed.groupBy(*KEYS).agg(F.count("*").alias("n_rows"), *sums)


def months_of(df: DataFrame) -> list[dt.date]:
    """The months of a load, for :func:`refresh` (an action; one line per month)."""
    return sorted(r["month"] for r in df.select(F.trunc("date", "month").alias("month")).distinct().collect() if r["month"])


def refresh(spark: SparkSession, clean: DataFrame, path: str, months: Collection[dt.date] | None = None) -> None:
    """Write the cube of ``clean`` (a stored clean table) to ``path``; with ``months``, only those.

    Partitions of other months stay as they are and are not read. A month without rows is
    replaced by one line of no rows, which the queries leave out.
    """
    rows = clean
    if months is not None and not months:
        return
    if months is not None:
        rows = rows.filter(F.col("month").isin([m.replace(day=1) for m in months]))
    lines = cube(rows)
    if months:
        marks = spark.createDataFrame([(m.replace(day=1), 0) for m in sorted(months)], "month date, n_rows long")
        lines = lines.unionByName(marks, allowMissingColumns=True)
    which = "static" if months is None else "dynamic"
    out = lines.hint("rebalance", "month").write.mode("overwrite").option("partitionOverwriteMode", which)
    out.partitionBy("month").parquet(path)


def read_cube(spark: SparkSession, path: str) -> DataFrame:
    """The stored lines. ``analytics.dashboard_filter`` applies to them as to rows, and prunes months."""
    return spark.read.parquet(path).filter(F.col("n_rows") > 0)


def trend(lines: DataFrame, grain: str = "day", measure: str = "count") -> DataFrame:
    """``analytics.trend`` from the lines of the cube."""
    bucketed = lines.withColumn("bucket", bucket(grain))
    if measure in MEASURES:
        mean = F.try_divide(F.sum(f"sum_{measure}"), F.sum(f"n_{measure}"))
        return bucketed.groupBy("bucket").agg(mean.alias(f"mean_{measure}"))
    counts = bucketed.groupBy("bucket", "class").agg(F.sum("n_rows").alias("n_rows"))
    if measure == "count":
        return counts
    if measure == "share":
        return counts.withColumn("share", _share_of("bucket"))
    raise ValueError("measure must be count, share, polarity or subjectivity")


def breakdown(lines: DataFrame, by: str) -> DataFrame:
    """``analytics.breakdown`` from the lines of the cube."""
    counts = lines.groupBy(by, "class").agg(F.sum("n_rows").alias("n_rows"))
    return counts.withColumn("share", _share_of(by))


def breakdown_sets(lines: DataFrame) -> DataFrame:
    """``analytics.breakdown_sets`` from the lines of the cube."""
    source, subject, klass = F.col("source"), F.col("subject"), F.col("class")
    sets = lines.select("source", "subject", "class", "n_rows").groupingSets(
        [[source, klass], [subject, klass], [klass]], source, subject, klass
    )
    return sets.agg(F.grouping_id().cast("bigint").alias("grouping_set"), F.sum("n_rows").alias("n_rows"))
