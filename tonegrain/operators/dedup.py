"""Duplicates: keep the first, find the copies, list what was removed.

Copies are grouped by a 32-byte digest of their key columns. One text may make up
a large share of the table, so no group is ever gathered whole: the dedup keeps
one row per key in every map task before the shuffle, the counts are partial
aggregates, and rows of heavy keys are listed without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonegrain.functions.digest import row_digest
from tonegrain.schema import DEDUP_KEYS
from tonegrain.sources.staging import stage

# Keys holding at least 1/HEAVY_SHARE of the repeated rows are heavy: there can be
# no more than HEAVY_SHARE of them, 32 bytes each.
HEAVY_SHARE = 100_000


def dedup_keep_first(df: DataFrame, keys: Sequence[str] = DEDUP_KEYS) -> DataFrame:
    """The earliest row per key, nulls equal, ties by ``row_id``.

    A ``row_number() = 1`` filter makes Spark put a WindowGroupLimit ahead of the
    shuffle, so a key sends at most one row from each map task.
    """
    first = Window.partitionBy("_key").orderBy(F.col("date").asc_nulls_last(), "row_id")
    return (
        df.withColumn("_key", row_digest(*keys))
        .withColumn("_rank", F.row_number().over(first))
        .filter("_rank = 1")
        .drop("_key", "_rank")
    )


def removed_rows(df: DataFrame, keys: Sequence[str] = DEDUP_KEYS) -> DataFrame:
    """Rows :func:`dedup_keep_first` drops.

    Keys that occur again, each with the row that stays, are found by partial
    aggregation of digests and staged (an action); only their rows are then picked.
    """
    keyed = df.withColumn("_key", row_digest(*keys))
    first = F.struct(F.col("date").isNull().alias("undated"), "date", "row_id")
    repeated = stage(
        keyed.groupBy("_key").agg(F.count("*").alias("n"), F.min(first)["row_id"].alias("_first")).filter("n > 1"),
        "repeated",
    )
    return _rows_with(keyed, repeated, "_first").filter(F.col("row_id") != F.col("_first")).drop("_first")


def _rows_with(keyed: DataFrame, repeated: DataFrame, *more: str) -> DataFrame:
    """Rows whose ``_key`` is in ``repeated``, with its columns ``more``.

    A table of few keys is broadcast after its size is checked. Else rows of heavy keys
    are picked by a broadcast and stay where they are; the others join by shuffle, where
    no key is large.
    """
    if repeated.count() <= HEAVY_SHARE:
        return keyed.join(F.broadcast(repeated.select("_key", *more)), "_key").drop("_key")
    total = repeated.agg(F.sum("n").alias("total")).scalar()
    is_heavy = F.col("n") * HEAVY_SHARE >= total
    heavy, light = (repeated.filter(c).select("_key", *more) for c in (is_heavy, ~is_heavy))
    of_heavy = keyed.join(F.broadcast(heavy), "_key")
    of_light = keyed.join(F.broadcast(heavy.select("_key")), "_key", "left_anti").join(light, "_key")
    return of_heavy.unionByName(of_light).drop("_key")


def dup_ratio(df: DataFrame, column: str = "text") -> DataFrame:
    """Share of rows repeating an earlier value; all nulls count as one value."""
    groups = df.groupBy(row_digest(column).alias("_key")).agg(F.count("*").alias("n"))
    total, distinct = F.sum("n"), F.count("*")
    return groups.agg(
        F.coalesce(total, F.lit(0)).alias("n_rows"),
        (total - distinct).alias("n_repeats"),
        ((total - distinct) / total).alias("dup_ratio"),
    )


def duplicate_rows(df: DataFrame, keys: Sequence[str], ordered: bool = True) -> DataFrame:
    """All rows whose key occurs more than once, sorted by it if ``ordered``.

    The repeated keys are counted and staged (an action). Rows of heavy keys are
    picked by a broadcast of those keys and stay where they are; the others join
    by shuffle, where no key is large. The sort ends in ``row_id``, so its ranges
    can cut through a heavy key.
    """
    keyed = df.withColumn("_key", row_digest(*keys))
    repeated = stage(
        keyed.groupBy("_key").agg(F.count("*").alias("n")).filter("n > 1"), "repeated"
    )
    copies = _rows_with(keyed, repeated)
    if not ordered:
        return copies
    return copies.orderBy(*[F.col(k).asc_nulls_last() for k in keys], "row_id")
