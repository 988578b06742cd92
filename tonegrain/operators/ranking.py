"""Row numbers and running maxima over groups of any size.

A window ranks a whole group in one task. Here the rows are range-partitioned by
(group, order) first, which cuts through heavy groups and heavy moments alike.
Each slice ranks its own rows; a small table of slice totals carries the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonegrain.sources.staging import stage


def slice_rows(df: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Range-partition by (group, order) and note the partition (an action).

    ``order`` must be unique within the group. The slices are written down,
    because the ranges of a second run could differ.
    """
    sliced = df.repartitionByRange(group, *order).withColumn("_slice", F.spark_partition_id())
    return stage(sliced, "slices")


def _with_carry(
    sliced: DataFrame, group: str, order: Sequence[str], totals: dict, carry: dict
) -> DataFrame:
    """Join to each row what the earlier slices of its group add up to.

    ``totals`` are aggregates per slice, ``carry`` combines them over the earlier
    slices. A group has one line per slice it touches.
    """
    earlier = (
        Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    per_slice = sliced.groupBy(group, "_slice").agg(
        *[expr.alias(name) for name, expr in totals.items()]
    )
    carried = per_slice.select(
        group, "_slice", *[expr.over(earlier).alias(f"_before_{n}") for n, expr in carry.items()]
    )
    return sliced.join(carried, [group, "_slice"])


def row_number_in_group(
    df: DataFrame, group: str, order: Sequence[str], name: str = "rank"
) -> DataFrame:
    """``row_number() over (partition by group order by order)``."""
    sliced = slice_rows(df, group, order)
    rows = _with_carry(sliced, group, order, {"n": F.count("*")}, {"n": F.sum("n")})
    local = F.row_number().over(Window.partitionBy(group, "_slice").orderBy(*order))
    return rows.withColumn(name, F.coalesce("_before_n", F.lit(0)) + local).drop(
        "_slice", "_before_n"
    )


def max_of_earlier(
    df: DataFrame,
    group: str,
    order: Sequence[str],
    value: str,
    name: str,
    rank_name: str = "rank",
) -> DataFrame:
    """Row number and the maximum of ``value`` over the earlier rows of the group."""
    sliced = slice_rows(df, group, order)
    rows = _with_carry(
        sliced,
        group,
        order,
        {"n": F.count("*"), "top": F.max(value)},
        {"n": F.sum("n"), "top": F.max("top")},
    )
    ordered = Window.partitionBy(group, "_slice").orderBy(*order)
    local_top = F.max(value).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    return (
        rows.withColumn(rank_name, F.coalesce("_before_n", F.lit(0)) + F.row_number().over(ordered))
        .withColumn(name, F.greatest("_before_top", local_top))
        .drop("_slice", "_before_n", "_before_top")
    )
