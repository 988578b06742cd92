"""Scoring requests in, responses out: JSON lines, in batch or as a stream.

A body is parsed once, as VARIANT, so the JSON type of a field is seen before it is cast: a number
where a text belongs is a fault of the request, not a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What a body of the wrong types is told.
NOT_AN_OBJECT = "body must be a JSON object"
TEXT_TYPE = "input_text must be a string"
TEXTS_TYPE = "input_texts must be a list of strings"


def _type(value: Column) -> Column:
    """JSON type of a VARIANT; VOID for a JSON null, null if there is no value."""
    return F.schema_of_variant(value)


def parse_requests(lines: DataFrame, column: str = "value") -> DataFrame:
    """``request_id, input_text, input_texts, _corrupt_record, _type_fault`` of JSON bodies, blank lines left out.

    A body that is no JSON keeps its text in ``_corrupt_record``; one with a field of the wrong type
    says which in ``_type_fault`` and has neither text. A null field is as good as none, as is a null in a
    list; the id may be any scalar.
    """
    body = F.try_parse_json(column)
    parsed = lines.filter(F.length(F.trim(column)) > 0).select(
        F.col(column).alias("_line"), body.alias("_body")
    )

    def field(name: str) -> Column:
        return F.try_variant_get("_body", f"$.{name}", "variant")

    text, texts = _type(field("input_text")), _type(field("input_texts"))
    lines_of = F.try_variant_get("_body", "$.input_texts", "array<variant>")
    odd_line = F.exists(lines_of, lambda x: ~F.coalesce(_type(x), F.lit("VOID")).isin("STRING", "VOID"))
    none = F.lit("VOID")
    fault = (
        F.when(~F.startswith(_type("_body"), F.lit("OBJECT")), NOT_AN_OBJECT)
        .when(~F.coalesce(text, none).isin("STRING", "VOID"), TEXT_TYPE)
        .when(~(F.coalesce(texts, none).startswith("ARRAY") | (F.coalesce(texts, none) == "VOID")) | odd_line, TEXTS_TYPE)
    )
    typed = parsed.withColumn("_type_fault", fault)
    sound = F.col("_type_fault").isNull()
    return typed.select(
        F.try_variant_get("_body", "$.request_id", "string").alias("request_id"),
        F.when(sound, F.try_variant_get("_body", "$.input_text", "string")).alias("input_text"),
        F.when(sound, F.try_variant_get("_body", "$.input_texts", "array<string>")).alias("input_texts"),
        F.when(F.col("_body").isNull(), F.col("_line")).alias("_corrupt_record"),
        "_type_fault",
    )


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests of JSON lines, see :func:`parse_requests`."""
    return parse_requests(spark.read.text(path))


def stream_requests(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return parse_requests(reader.text(path))


def write_responses(df: DataFrame, path: str, fmt: str = "json", mode: str = "error") -> None:
    """Write response envelopes as JSON lines or Parquet."""
    df.write.format(fmt).mode(mode).save(path)
