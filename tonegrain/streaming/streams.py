"""The batch operators on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PythonException, SparkRuntimeException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tonegrain.functions.digest import row_digest
from tonegrain.operators.clean import filter_news, finish_news
from tonegrain.operators.requests import (
    ModelError,
    check_labels,
    clean_requests,
    model_failed,
    score_requests,
    unavailable,
)
from tonegrain.operators.serving import ProductionModel, serve
from tonegrain.schema import DATE_FORMAT, DEDUP_KEYS
from tonegrain.sources.requests import write_responses
from tonegrain.sources.staging import stage

Scorer = Callable[[DataFrame], DataFrame]


def stream_score(
    requests: DataFrame, scorer: Scorer, out: str, checkpoint: str
) -> StreamingQuery:
    """Score a request stream: ``out/scores`` and ``out/rejects``, by batch.

    Each batch overwrites its own folder, so a replayed batch leaves one copy.
    The scorer is called for each batch and may look up the production model
    then; if the model fails, the batch's requests are answered with status 503. Other
    failures, of storage or of the cluster, fail the batch, which is then tried again.
    Requests with a label outside the known classes are answered with status 500.
    """

    def answer(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            _, errors = clean_requests(batch)
            try:
                scored = stage(score_requests(batch, scorer), "stream-scores")
            except (ModelError, PythonException, SparkRuntimeException) as e:
                if not model_failed(e):
                    raise  # not the model's fault: the batch fails and is tried again
                reason = f"model prediction failed: {type(e).__name__}"
                errors = errors.unionByName(unavailable(batch, reason))
            else:
                good, unknown = check_labels(scored)
                errors = errors.unionByName(unknown)
                good.drop("request_no").write.mode("overwrite").parquet(f"{out}/scores/batch_id={batch_id}")
            errors.write.mode("overwrite").parquet(f"{out}/rejects/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return (
        requests.writeStream.foreachBatch(answer)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_serve(requests: DataFrame, production: ProductionModel, out: str, checkpoint: str) -> StreamingQuery:
    """Answer a request stream with the production model: ``out/responses`` and ``out/rejects``, by batch.

    The alias is read anew for each batch, so a promotion counts from the next batch on. A replayed batch
    overwrites its folders. Faults of the model are answered with status 503, others fail the batch.
    """

    def answer(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            envelopes, errors = serve(batch, production)
            if envelopes is not None:
                write_responses(envelopes, f"{out}/responses/batch_id={batch_id}", "parquet", "overwrite")
            errors.write.mode("overwrite").parquet(f"{out}/rejects/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return (
        requests.writeStream.foreachBatch(answer)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_clean(news: DataFrame, date_format: str = DATE_FORMAT) -> DataFrame:
    """All cleaning but the dedup, with the column functions of the batch form."""
    return finish_news(filter_news(news, date_format))


def stream_trend(clean: DataFrame, delay: str, grain: str = "1 day") -> DataFrame:
    """Rows per class and tumbling window of event time.

    In append mode a window appears once the watermark has passed its end, and
    later rows for it are dropped. Complete mode equals the batch trend.
    """
    return (
        clean.withWatermark("date", delay)
        .groupBy(F.window("date", grain), "class")
        .agg(F.count("*").alias("n_rows"))
        .select(F.col("window.start").cast("date").alias("bucket"), "class", "n_rows")
    )


def stream_dedup(clean: DataFrame, delay: str) -> DataFrame:
    """Drop copies of a (text, title, class) key that arrive within ``delay``.

    Keeps the first to *arrive*, where the batch form keeps the earliest date.
    State holds digests, not texts, one entry per key.
    """
    marked = clean.withWatermark("date", delay).withColumn("_key", row_digest(*DEDUP_KEYS))
    return marked.dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def run_to_table(df: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Drain a stream into Parquet in append mode and read it back (an action)."""
    query = (
        df.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)


def run_complete(df: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Drain an aggregation in complete mode; the last batch is the result."""

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    query = (
        df.writeStream.foreachBatch(replace)
        .option("checkpointLocation", checkpoint)
        .outputMode("complete")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)
