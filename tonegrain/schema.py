"""Schemas and fixed values."""

from __future__ import annotations

from pyspark.sql import types as T

# The accepted sentiment classes, in label order.
CLASSES = ("negative", "neutral", "positive")

# The strings a CSV load reads as missing.
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Fixed value: the one timestamp format of the input.
DATE_FORMAT = "yyyy-MM-dd HH:mm:ss"

MANDATORY = ("date", "sentiment", "source", "subject")
BODY = ("text", "title")
DEDUP_KEYS = ("text", "title", "class")

NEWS_RAW = T.StructType(
    [
        T.StructField("row_id", T.LongType(), False),
        T.StructField("date", T.StringType()),
        T.StructField("sentiment", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

REQUEST = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("input_text", T.StringType()),
        T.StructField("input_texts", T.ArrayType(T.StringType())),
    ]
)

# Columns of the cleaned table, in output order.
NEWS_CLEAN_COLUMNS = (
    "row_id",
    "date",
    "source",
    "subject",
    "title",
    "text",
    "class",
    "polarity",
    "subjectivity",
    "input_text",
)
