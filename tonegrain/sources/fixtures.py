"""Maps the driver tables onto the input schemas of the engine.

The driver tables hold documents, labels, conversations and events; the engine
takes raw news, scoring requests, predictions and run histories. Each adapter is
one projection, so its work grows with the table it reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegrain.schema import CLASSES, REQUEST


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _two_digits(value: Column) -> Column:
    return F.lpad(value.cast("string"), 2, "0")


def news_raw(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents as raw news; works on a stream of documents as well."""
    d = documents.select("doc_id", "text", "lang", "source")
    marked = labels.select("doc_id", "quality", "toxic", F.lit(True).alias("has_label"))
    joined = d.join(marked, "doc_id", "left").withColumn(
        "labelled", F.coalesce("has_label", F.lit(False))
    )
    k, text = F.col("doc_id"), F.col("text")
    date = (
        F.when(k % 97 == 5, "not a date")
        .when(k % 89 == 5, "2024-03-01")
        .otherwise(
            F.concat(
                F.lit("2024-"),
                _two_digits(1 + (k * 7) % 12),
                F.lit("-"),
                _two_digits(1 + (k * 5) % 28),
                F.lit(" "),
                _two_digits(k % 24),
                F.lit(":"),
                _two_digits(k % 60),
                F.lit(":00"),
            )
        )
    )
    klass = (
        F.when(~F.col("labelled"), "mixed")
        .when(F.col("toxic") == 1, "negative")
        .when(F.col("quality") == 1, "positive")
        .otherwise("neutral")
    )
    polarity = (
        F.when(k % 23 == 0, "None")
        .when(F.col("toxic") == 1, F.concat(F.lit("-0."), _two_digits(1 + k % 99)))
        .otherwise(F.concat(F.lit("0."), _two_digits(k % 100)))
    )
    sentiment = F.when(
        F.col("labelled") | (k % 2 != 0),
        F.concat(
            F.lit("{'class': '"),
            klass,
            F.lit("', 'polarity': "),
            polarity,
            F.lit(", 'subjectivity': 0."),
            _two_digits((k * 3) % 100),
            F.lit("}"),
        ),
    )
    first_line = F.substring_index(text, "\n", 1)
    title = F.when(
        k % 17 != 0,
        F.when(k % 19 == 0, F.concat(F.lit(". .."), first_line)).otherwise(first_line),
    )
    body = F.when(
        (k % 13 != 0) & (F.instr(text, "\n") != 0), F.expr("substr(text, instr(text, '\n') + 1)")
    )
    return joined.select(
        k.alias("row_id"),
        date.alias("date"),
        sentiment.alias("sentiment"),
        F.when(k % 101 != 3, F.col("source")).alias("source"),
        F.col("lang").alias("subject"),
        title.alias("title"),
        body.alias("text"),
    )


def load_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news_raw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def requests(conversations: DataFrame) -> DataFrame:
    """One request per turn: users send one text, the others a list of lines.

    The list comes out of its own row, so no request is gathered from a group.
    """
    c = F.col("conv_id")
    text = (
        F.when(c % 5 == 0, "   ")
        .when(c % 7 == 3, "")
        .when(c % 3 == 0, F.concat(F.lit("  "), F.col("text"), F.lit(" ")))
        .otherwise(F.col("text"))
    )
    single = F.col("role") == "user"
    return conversations.select(
        F.concat_ws("-", F.col("conv_id"), F.col("turn")).alias("request_id"),
        F.when(single, text).alias("input_text"),
        F.when(~single, F.split(text, "\n")).alias("input_texts"),
    ).to(REQUEST)


def load_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(table(spark, sf_dir, "conversations"))


def request_bodies(conversations: DataFrame) -> DataFrame:
    """One JSON body per turn, ``value``: by conversation, a text, a list, a number, a mixed list, a flag, or no JSON."""
    kind, item = F.pmod("conv_id", F.lit(8)), F.to_json(F.struct("text"))
    # The text as a JSON string: what stands behind the field name in the object of one field.
    text = F.expr("substring(_item, 9, length(_item) - 9)")
    field = (
        F.when(kind == 0, F.lit('"input_text":7'))
        .when(kind == 1, F.concat(F.lit('"input_texts":['), text, F.lit(",5]")))
        .when(kind == 2, F.lit('"input_texts":true'))
        .when(kind == 3, F.concat(F.lit('"input_texts":['), text, F.lit(",null]")))
        .when(kind == 4, F.concat(F.lit('"input_text":null,"input_texts":['), text, F.lit("]")))
        .when(kind == 5, F.lit('"input_text":"broken'))
        .when(kind == 6, F.lit('"input_text":{"a":[1]}'))
        .otherwise(F.concat(F.lit('"input_text":'), text))
    )
    request_id = F.concat_ws("-", "conv_id", "turn")
    return conversations.withColumn("_item", item).select(
        F.concat(F.lit('{"request_id":"'), request_id, F.lit('",'), field, F.lit("}")).alias("value")
    )


def predictions(clean: DataFrame) -> DataFrame:
    """Two fixed classifiers over the cleaned news, with their latencies."""
    k, c = F.col("row_id"), F.col("class")
    linear = F.when(
        k % 5 == 0,
        F.when(c == "positive", "neutral").when(c == "neutral", "negative").otherwise("positive"),
    ).otherwise(c)
    encoder = F.when(
        k % 7 == 0,
        F.when(c == "positive", "negative").when(c == "neutral", "positive").otherwise("neutral"),
    ).otherwise(c)
    return clean.select(
        "row_id",
        "date",
        "class",
        linear.alias("pred_linear"),
        encoder.alias("pred_encoder"),
        (5 + k % 11).cast("int").alias("latency_linear_ms"),
        (40 + k % 37).cast("int").alias("latency_encoder_ms"),
    )


def coefficients(vocab: DataFrame) -> DataFrame:
    """A fixed weight for each term and class, in long form."""
    per_class = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("class"),
                    (
                        ((F.length("term") * 7 + F.ascii("term") * (i + 1)) % 11 - 5) / F.lit(10.0)
                    ).alias("weight"),
                )
                for i, name in enumerate(CLASSES)
            ]
        )
    )
    return vocab.select("term", per_class.alias("c")).select("term", "c.class", "c.weight")


def runs(events: DataFrame) -> DataFrame:
    """Run history: one model name per event type."""
    return events.select(
        F.col("event_type").alias("name"),
        F.col("event_id").alias("run_id"),
        F.col("ts").alias("logged_at"),
        (F.col("value") / 100.0).alias("test_f1_score"),
    )


def load_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(table(spark, sf_dir, "events"))
