"""Reading the raw news table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonegrain.schema import NA_TOKENS, NEWS_RAW


def read_news(spark: SparkSession, path: str, schema: T.StructType = NEWS_RAW, keep_corrupt: bool = False) -> DataFrame:
    """Headered CSV with quoted, multi-line fields; missing tokens become null.

    Columns are found by their header names, in any order; further columns are ignored, a
    missing one is a ``ValueError``, and files of one path must agree. A file without
    ``row_id`` gets one that holds as long as the files do: store the table once with
    :func:`news_to_parquet`. With ``keep_corrupt`` a malformed record's text is kept in
    ``_corrupt_record``.

    Quoted line breaks make a file unsplittable, so a file is one task: keep the
    drop as many files. A path that does not exist raises Spark's ``AnalysisException``.
    """
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    names = spark.read.options(**options).csv(path).columns
    missing = [f.name for f in schema.fields if f.name not in names and f.name != "row_id"]
    if missing:
        raise ValueError(f"columns not in the header of {path}: {', '.join(missing)}")
    own = T.StructType([T.StructField(n, T.StringType()) for n in (*names, "_corrupt_record")])
    raw = (
        spark.read.schema(own).options(**options)
        .option("enforceSchema", False)
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .csv(path)
    )
    row_id = F.col("row_id").cast("long") if "row_id" in names else F.monotonically_increasing_id()
    columns = [row_id.alias("row_id"), *[F.col(f.name).cast(f.dataType) for f in schema.fields if f.name != "row_id"]]
    kept = [F.col("_corrupt_record")] if keep_corrupt else []
    return na_normalise(raw.select(*columns, *kept))


def write_news_csv(df: DataFrame, path: str) -> None:
    """Write the CSV form :func:`read_news` takes back unchanged."""
    (
        df.write.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("emptyValue", "")
        .csv(path)
    )


def news_to_parquet(spark: SparkSession, csv_path: str, parquet_path: str) -> DataFrame:
    """One-time conversion of a CSV drop into a splittable, prunable table."""
    read_news(spark, csv_path).write.parquet(parquet_path)
    return spark.read.parquet(parquet_path)


def write_clean(df: DataFrame, path: str) -> None:
    """Store the cleaned table partitioned by the month of ``date``.

    The rebalance collects a month into few files and splits a month that is far
    larger than the others.
    """
    monthly = df.withColumn("month", F.trunc("date", "month"))
    monthly.hint("rebalance", "month").write.partitionBy("month").parquet(path)


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    """The stored table; bounds on ``month`` prune its partitions."""
    return spark.read.parquet(path)


def na_normalise(df: DataFrame, tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """Null for every missing-value token in every string column."""
    return df.select(
        *[
            F.when(~F.col(f.name).isin(*tokens), F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def load_stats(df: DataFrame) -> DataFrame:
    """Row and column counts of a load."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
    )
