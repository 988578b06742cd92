"""A trend table that takes rows of any age, in additive batches.

Each micro-batch adds one small folder of counts per bucket and class, named after the batch. A row that comes
years late is a correction of its bucket like any other, so no watermark drops it and no state is kept; a
replayed batch overwrites its own folder. Now and then the folders are added up into a base,
and what the base before it covered is deleted. Only folders whose write has ended are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tonegrain.operators.analytics import bucket
from tonegrain.sources.staging import discard

SCHEMA = "bucket date, class string, n_rows bigint"


def _complete(spark: SparkSession, folder: str) -> dict[int, str]:
    """Finished folders ``<folder>=<number>`` by their number."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}=*/_SUCCESS")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    parents = [f.getPath().getParent() for f in found or []]
    return {int(p.getName().split("=")[1]): p.toString() for p in parents}


def _added_up(counts: DataFrame) -> DataFrame:
    return counts.groupBy("bucket", "class").agg(F.sum("n_rows").alias("n_rows"))


def add_batch(clean: DataFrame, batch_id: int, out: str, grain: str = "day") -> None:
    """Write the counts of a batch of clean rows; the same batch again changes nothing."""
    counts = clean.groupBy(bucket(grain).cast("date").alias("bucket"), "class").agg(F.count("*").alias("n_rows"))
    counts.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")


def read_trend(spark: SparkSession, out: str) -> DataFrame:
    """``bucket, class, n_rows`` over all batches written so far; no lines if there are none."""
    bases, batches = _complete(spark, f"{out}/base"), _complete(spark, f"{out}/batch")
    last = max(bases, default=-1)
    paths = [path for i, path in sorted(batches.items()) if i > last]
    if bases:
        paths.append(bases[last])
    if not paths:
        return spark.createDataFrame([], SCHEMA)
    return _added_up(spark.read.schema(SCHEMA).parquet(*paths))


def compact(spark: SparkSession, out: str, batch_id: int) -> None:
    """Add all batches up to ``batch_id``, the last one written, into a base.

    The batches it holds stay until the next base, for readers that have listed them.
    """
    before = _complete(spark, f"{out}/base")
    if batch_id in before:
        return
    read_trend(spark, out).write.mode("overwrite").parquet(f"{out}/base={batch_id}")
    covered = max(before, default=-1)
    old = [path for i, path in _complete(spark, f"{out}/batch").items() if i <= covered]
    for path in [*old, *[path for i, path in before.items() if i < covered]]:
        discard(spark, path)


def stream_trend_table(
    clean: DataFrame, out: str, checkpoint: str, grain: str = "day", compact_every: int = 100
) -> StreamingQuery:
    """Keep the trend table of a clean stream; it equals the batch trend of the rows so far, in whatever order they came."""

    def add(batch: DataFrame, batch_id: int) -> None:
        add_batch(batch, batch_id, out, grain)
        if (batch_id + 1) % compact_every == 0:
            compact(batch.sparkSession, out, batch_id)

    return (
        clean.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
