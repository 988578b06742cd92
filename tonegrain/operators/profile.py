"""Profiling queries over the parsed table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def class_count(df: DataFrame) -> DataFrame:
    """Rows per class, most frequent first; null classes are not counted."""
    counts = df.filter(F.col("class").isNotNull()).groupBy("class")
    return counts.agg(F.count("*").alias("n_rows")).orderBy(F.desc("n_rows"), "class")


def class_ratio(df: DataFrame) -> DataFrame:
    """Share per class; the total is taken over the grouped counts."""
    counts = df.filter(F.col("class").isNotNull()).groupBy("class")
    counts = counts.agg(F.count("*").alias("n_rows"))
    total = counts.agg(F.sum("n_rows").alias("total"))
    return counts.select(
        "class", "n_rows", (F.col("n_rows") / total.scalar()).alias("ratio")
    ).orderBy(F.desc("n_rows"), "class")


def date_range(df: DataFrame) -> DataFrame:
    return df.agg(F.min("date").alias("min_date"), F.max("date").alias("max_date"))


def null_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """For each column: does it hold a null? One pass."""
    return df.agg(
        *[
            F.coalesce(F.bool_or(F.col(c).isNull()), F.lit(False)).alias(f"{c}_has_null")
            for c in columns
        ]
    )


def table_profile(df: DataFrame) -> DataFrame:
    """Name, type, non-null and total count of each column, in one aggregate."""
    counted = df.agg(F.count("*").alias("_rows"), *[F.count(c).alias(c) for c in df.columns])
    lines = [
        F.struct(
            F.lit(i).cast("bigint").alias("position"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("column_type"),
            F.col(f.name).alias("non_null"),
            F.col("_rows").alias("n_rows"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return counted.select(F.inline(F.array(*lines)))


def head_rows(df: DataFrame, n: int = 5) -> DataFrame:
    """First rows by ``row_id``."""
    return df.orderBy("row_id").limit(n)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values, null included."""
    return df.select(column).distinct()


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    """Distinct values in order, nulls last."""
    return distinct_values(df, column).orderBy(F.col(column).asc_nulls_last())


def describe_by(df: DataFrame, group: str, value: str) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum.

    ``value`` is taken in whole numbers (latencies in milliseconds). It is reduced
    to a histogram first, with partial counts ahead of the shuffle, so a heavy group
    arrives as one line per distinct value and exact percentiles need no sketch.
    """
    whole = df.withColumn(value, F.round(value).cast("bigint"))
    histogram = (
        whole.filter(F.col(group).isNotNull() & F.col(value).isNotNull())
        .groupBy(group, value)
        .agg(F.count("*").alias("n"))
    )
    v, n = F.col(value).cast("double"), F.col("n")
    everyone = Window.partitionBy(group)
    mean = F.sum(v * n).over(everyone) / F.sum(n).over(everyone)
    total = F.sum("n")
    quartiles = F.percentile(F.col(value), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), n)
    summary = (
        histogram.withColumn("_mean", mean)
        .withColumn("_dev", (v - F.col("_mean")) * (v - F.col("_mean")) * n)
        .groupBy(group)
        .agg(
            total.alias("n_rows"),
            F.first("_mean").alias("mean"),
            F.when(total > 1, F.sqrt(F.sum("_dev") / (total - 1))).alias("std"),
            F.min(value).cast("bigint").alias("min"),
            quartiles.alias("_q"),
            F.max(value).cast("bigint").alias("max"),
        )
    )
    return summary.select(
        group,
        "n_rows",
        "mean",
        "std",
        "min",
        F.col("_q")[0].alias("p25"),
        F.col("_q")[1].alias("p50"),
        F.col("_q")[2].alias("p75"),
        "max",
    )


def text_len_by_class(df: DataFrame) -> DataFrame:
    """Distribution of the text length in code points, by class."""
    lengths = df.select("class", F.length("text").alias("text_len"))
    return describe_by(lengths, "class", "text_len")


# Size parameter of quantile sketches.
SKETCH_K = 1024


def sketch_rank_error(k: int = SKETCH_K) -> float:
    """Rank error of a KLL sketch that 99 % of its quantiles keep, as published for the sketch."""
    return 2.296 / k**0.9723


def quantile_sketches(df: DataFrame, group: str, value: str, period: str = "month", k: int = SKETCH_K) -> DataFrame:
    """``group, period, sketch, n_rows``: a mergeable KLL sketch of ``value`` for each period of ``date``.

    Stored, it answers for any span of periods without the rows. Rows without a group or value are left out; those
    without a date have the period null. Partial sketches are made ahead of the shuffle, so a
    heavy group sends one per task. :func:`describe_by` is the exact form.
    """
    whole = df.select(
        group, F.date_trunc(period, "date").cast("date").alias("period"), F.round(value).cast("bigint").alias("_value")
    ).filter(F.col(group).isNotNull() & F.col("_value").isNotNull())
    return whole.groupBy(group, "period").agg(
        F.kll_sketch_agg_bigint("_value", k).alias("sketch"), F.count("*").alias("n_rows")
    )


def merged_quantiles(sketches: DataFrame, group: str, k: int = SKETCH_K) -> DataFrame:
    """``group, n_rows, p25, p50, p75`` over all periods given."""
    quartiles = F.kll_sketch_get_quantile_bigint("_all", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    merged = sketches.groupBy(group).agg(
        F.kll_merge_agg_bigint("sketch", k).alias("_all"), F.sum("n_rows").alias("n_rows")
    )
    return merged.withColumn("_q", quartiles).select(
        group, "n_rows", *[F.col("_q")[i].alias(p) for i, p in enumerate(("p25", "p50", "p75"))]
    )


def rank_errors(df: DataFrame, quantiles: DataFrame, group: str, value: str) -> DataFrame:
    """How far the rank of each quantile of :func:`merged_quantiles` lies from its own, as a share of the rows."""
    v = F.round(value).cast("bigint")
    ranks = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    shares = [
        e
        for p in ranks
        for e in (F.avg((v < F.col(p)).cast("int")).alias(f"_below_{p}"), F.avg((v <= F.col(p)).cast("int")).alias(f"_upto_{p}"))
    ]
    # One line per group.
    counted = df.select(group, value).join(F.broadcast(quantiles), group).groupBy(group).agg(F.first("n_rows").alias("n_rows"), *shares)
    off = [
        F.greatest(F.lit(0.0), F.col(f"_below_{p}") - rank, rank - F.col(f"_upto_{p}")).alias(f"{p}_error")
        for p, rank in ranks.items()
    ]
    return counted.select(group, "n_rows", *off)
