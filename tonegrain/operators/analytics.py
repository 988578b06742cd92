"""Dashboard queries: trends, breakdowns, latest news, model comparison."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonegrain.operators.profile import describe_by

# The time granularities of the dashboard.
GRAINS = ("day", "week", "month", "year")

# A heavy group is ranked in this many slices before its finalists meet.
SALTS = 64


def bucket(grain: str, column: str = "date") -> Column:
    """First day of the bucket; weeks start on Monday."""
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {GRAINS}")
    return F.date_trunc(grain, column).cast("date")


def dashboard_filter(
    df: DataFrame,
    start: dt.date | None = None,
    end: dt.date | None = None,
    sources: Sequence[str] | None = None,
    subjects: Sequence[str] | None = None,
) -> DataFrame:
    """Rows in a range of days, both ends included, and in the given lists.

    The bounds compare ``date`` itself, so they reach the Parquet scan. On the
    stored table they bound its ``month`` too, which prunes partitions.
    """
    if start is not None:
        df = df.filter(F.col("date") >= F.lit(start).cast("timestamp"))
        if "month" in df.columns:
            df = df.filter(F.col("month") >= F.lit(start.replace(day=1)))
    if end is not None:
        df = df.filter(F.col("date") < F.lit(end + dt.timedelta(days=1)).cast("timestamp"))
        if "month" in df.columns:
            df = df.filter(F.col("month") <= F.lit(end))
    if sources is not None:
        df = df.filter(F.col("source").isin(list(sources)))
    if subjects is not None:
        df = df.filter(F.col("subject").isin(list(subjects)))
    return df


def trend(df: DataFrame, grain: str = "day", measure: str = "count") -> DataFrame:
    """Sentiment over time: ``count``, ``share``, ``polarity`` or ``subjectivity``.

    Buckets without rows are absent; :func:`fill_buckets` adds them.
    """
    bucketed = df.withColumn("bucket", bucket(grain))
    if measure in ("polarity", "subjectivity"):
        return bucketed.groupBy("bucket").agg(F.avg(measure).alias(f"mean_{measure}"))
    counts = bucketed.groupBy("bucket", "class").agg(F.count("*").alias("n_rows"))
    if measure == "count":
        return counts
    if measure == "share":
        return counts.withColumn("share", _share_of("bucket"))
    raise ValueError("measure must be count, share, polarity or subjectivity")


def _share_of(*group: str) -> Column:
    """Share in a group of an already counted table (one line per class)."""
    return F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy(*group))


def fill_buckets(counts: DataFrame, grain: str = "day") -> DataFrame:
    """Zero lines for buckets a counted trend lacks between its first and last."""
    steps = {"day": "1 day", "week": "7 days", "month": "1 month", "year": "1 year"}
    spans = counts.groupBy("class").agg(F.lit(1).alias("_one")).drop("_one")
    first = counts.agg(F.min("bucket").alias("b")).scalar()
    last = counts.agg(F.max("bucket").alias("b")).scalar()
    calendar = spans.select(
        F.explode(F.sequence(first, last, F.expr(f"interval {steps[grain]}"))).alias("bucket"),
        "class",
    )
    return calendar.join(counts, ["bucket", "class"], "left").fillna(0, ["n_rows"])


def breakdown(df: DataFrame, by: str) -> DataFrame:
    """Class distribution for each value of a column: count and share."""
    counts = df.groupBy(by, "class").agg(F.count("*").alias("n_rows"))
    return counts.withColumn("share", _share_of(by))


def breakdown_sets(df: DataFrame) -> DataFrame:
    """By source, by subject and overall, in one scan."""
    source, subject, klass = F.col("source"), F.col("subject"), F.col("class")
    sets = df.select("source", "subject", "class").groupingSets(
        [[source, klass], [subject, klass], [klass]], source, subject, klass
    )
    return sets.agg(
        F.grouping_id().cast("bigint").alias("grouping_set"), F.count("*").alias("n_rows")
    )


def latest(df: DataFrame, by: str, value: str, n: int = 10) -> DataFrame:
    """Newest rows of one source or subject: a top-k, no full sort."""
    return df.filter(F.col(by) == value).orderBy(F.desc("date"), "row_id").limit(n)


def latest_per_group(df: DataFrame, by: str, n: int = 10) -> DataFrame:
    """Newest rows of every source or subject.

    Two rankings: each group first in slices of map tasks, where Spark keeps n rows
    per task, then over the at most ``SALTS * n`` finalists of the group.
    """
    newest = [F.col("date").desc(), F.col("row_id")]
    sliced = Window.partitionBy(by, "_salt").orderBy(*newest)
    whole = Window.partitionBy(by).orderBy(*newest)
    finalists = (
        df.withColumn("_salt", F.spark_partition_id() % SALTS)
        .withColumn("_rank", F.row_number().over(sliced))
        .filter(F.col("_rank") <= n)
        .drop("_salt", "_rank")
    )
    return finalists.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= n)


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Predictions of two models on the same inputs, side by side by ``row_id``.

    Both frames hold ``row_id`` and ``prediction``; ``a`` also the true class.
    """
    left = a.select("row_id", "class", F.col("prediction").alias("prediction_a"))
    right = b.select("row_id", F.col("prediction").alias("prediction_b"))
    return left.join(right, "row_id").withColumn(
        "is_match", F.col("prediction_a") == F.col("prediction_b")
    )


def match_rate(compared: DataFrame) -> DataFrame:
    """Share of equal predictions, for each class and overall (``all``)."""
    counts = compared.rollup("class").agg(
        F.grouping("class").alias("_all"),
        F.count("*").alias("n_rows"),
        F.avg(F.col("is_match").cast("int")).alias("match_rate"),
    )
    return counts.select(
        F.when(F.col("_all") == 1, "all").otherwise(F.col("class")).alias("class"),
        "n_rows",
        "match_rate",
    )


def latency_summary(latencies: DataFrame) -> DataFrame:
    """Distribution of ``latency_ms`` for each ``model``."""
    return describe_by(latencies, "model", "latency_ms")
