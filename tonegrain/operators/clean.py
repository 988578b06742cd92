"""Row-level cleaning. Every function but the rejects is one narrow projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegrain.functions.digest import row_digest
from tonegrain.functions.literals import to_number, with_literal_fields
from tonegrain.functions.text import model_input
from tonegrain.operators.dedup import dedup_keep_first, removed_rows
from tonegrain.schema import (
    BODY,
    CLASSES,
    DATE_FORMAT,
    DEDUP_KEYS,
    MANDATORY,
    NEWS_CLEAN_COLUMNS,
)


def _all_present(columns: tuple[str, ...]) -> Column:
    present = F.lit(True)
    for c in columns:
        present = present & F.col(c).isNotNull()
    return present


def _body_present() -> Column:
    return F.coalesce(*BODY).isNotNull()


def _class_valid() -> Column:
    return F.coalesce(F.col("class").isin(*CLASSES), F.lit(False))


def coerce_date(df: DataFrame, date_format: str = DATE_FORMAT) -> DataFrame:
    """String date to timestamp in one format; any other string becomes null."""
    return df.withColumn("date", F.try_to_timestamp("date", F.lit(date_format)))


def invalid_dates(df: DataFrame, date_format: str = DATE_FORMAT) -> DataFrame:
    """Raw date strings that do not parse, rows null to begin with included."""
    parsed = F.try_to_timestamp("date", F.lit(date_format))
    return df.filter(parsed.isNull()).select("row_id", F.col("date").alias("date_raw"))


def drop_missing_mandatory(df: DataFrame) -> DataFrame:
    return df.filter(_all_present(MANDATORY))


def drop_missing_body(df: DataFrame) -> DataFrame:
    return df.filter(_body_present())


def parse_sentiment(df: DataFrame, col: str = "sentiment") -> DataFrame:
    """Adds ``class``, ``polarity`` and ``subjectivity`` as strings."""
    return with_literal_fields(df, col)


def coerce_scores(df: DataFrame) -> DataFrame:
    """Polarity and subjectivity to double; what is no number becomes null."""
    return df.withColumns({c: to_number(F.col(c)) for c in ("polarity", "subjectivity")})


def valid_class(df: DataFrame) -> DataFrame:
    """Keep the three classes; case-sensitive, untrimmed, null dropped."""
    return df.filter(_class_valid())


def build_input_text(df: DataFrame) -> DataFrame:
    return df.withColumn("input_text", model_input(F.col("title"), F.col("text")))


def feature_projection(df: DataFrame) -> DataFrame:
    return df.select("row_id", "input_text", "class")


def parse_news(df: DataFrame, date_format: str = DATE_FORMAT) -> DataFrame:
    """Dates, labels and scores parsed, no row dropped: the profiling input."""
    return coerce_scores(parse_sentiment(coerce_date(df, date_format)))


def filter_news(df: DataFrame, date_format: str = DATE_FORMAT) -> DataFrame:
    """Dates, labels and scores parsed, invalid rows dropped: stateless."""
    present = drop_missing_body(drop_missing_mandatory(coerce_date(df, date_format)))
    return coerce_scores(valid_class(parse_sentiment(present))).drop("sentiment")


def finish_news(df: DataFrame) -> DataFrame:
    """Adds ``input_text``; done last, so that each text is shuffled once only."""
    return build_input_text(df).select(*NEWS_CLEAN_COLUMNS)


def tag_rejects(df: DataFrame, date_format: str = DATE_FORMAT) -> DataFrame:
    """Parsed rows with ``reject_reason``; null means the row passes the filters."""
    return parse_news(df, date_format).withColumn(
        "reject_reason",
        F.when(~(_all_present(MANDATORY) & _body_present()), "missing").when(
            ~_class_valid(), "invalid_class"
        ),
    )


def clean_table(df: DataFrame, date_format: str = DATE_FORMAT) -> DataFrame:
    """The cleaned table: one scan and one shuffle."""
    return finish_news(dedup_keep_first(filter_news(df, date_format)))


def rejected_rows(df: DataFrame, date_format: str = DATE_FORMAT) -> DataFrame:
    """The rows :func:`clean_table` leaves out, with their ``reject_reason``.

    The reason is ``missing``, ``invalid_class`` or ``duplicate``.
    """
    tagged = tag_rejects(df, date_format)
    filtered_out = tagged.filter(F.col("reject_reason").isNotNull())
    passing = tagged.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    duplicates = removed_rows(passing).withColumn("reject_reason", F.lit("duplicate"))
    return filtered_out.unionByName(duplicates)


def clean_news(
    df: DataFrame, date_format: str = DATE_FORMAT
) -> tuple[DataFrame, DataFrame]:
    """The cleaned table and the quarantined rows."""
    return clean_table(df, date_format), rejected_rows(df, date_format)


def reject_report(df: DataFrame, date_format: str = DATE_FORMAT) -> DataFrame:
    """Dropped rows per reason, in one scan and without ranking the duplicates.

    Rows group by reason and, if they pass, by content: a group of n equal rows
    means n - 1 duplicates. Only digests and partial counts are shuffled.
    """
    tagged = tag_rejects(df, date_format)
    content = F.when(F.col("reject_reason").isNull(), row_digest(*DEDUP_KEYS))
    groups = (
        tagged.select("reject_reason", content.alias("content"))
        .groupBy("reject_reason", "content")
        .agg(F.count("*").alias("n"))
    )
    dropped = F.when(F.col("reject_reason").isNull(), F.col("n") - 1).otherwise(F.col("n"))
    return (
        groups.select(
            F.coalesce("reject_reason", F.lit("duplicate")).alias("reject_reason"),
            dropped.alias("dropped"),
        )
        .groupBy("reject_reason")
        .agg(F.sum("dropped").alias("n_rows"))
        .filter("n_rows > 0")
    )
