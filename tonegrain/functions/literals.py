"""Label literals such as ``{'class': 'positive', 'polarity': 0.1, ...}``."""

from __future__ import annotations

import ast
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ship this module's functions with the job, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The plain three-key form with simple values; anything else takes the slow path.
_NUMBER = r"[-+]?(?:0|[1-9][0-9]{0,17})(?:\.[0-9]{1,40})?|None"
CANONICAL = (
    r"^\{'class': '([^'\\\x00-\x1f]*)', "
    rf"'polarity': ({_NUMBER}), 'subjectivity': ({_NUMBER})\}}\z"
)

_FIELDS = ("class", "polarity", "subjectivity")
_RECORD = T.StructType([T.StructField(name, T.StringType()) for name in _FIELDS])

# Characters of a decimal number. The cast alone would also take suffixes as in
# 1.0d, hexadecimal and NaN, which are no numbers here.
_DECIMAL = r"^[-+.0-9eE\s]+$"
_INFINITE = r"(?i)^\s*[-+]?(?:inf|infinity)\s*$"


def _as_text(value: object) -> str | None:
    """Numbers as numbers: a truth value is 1.0 or 0.0, which the string 'True' is not."""
    if isinstance(value, bool):
        return str(float(value))
    return None if value is None else str(value)


def read_literal(source: str | None) -> dict[str, str | None]:
    """Fields of one dict literal, all null if it is not one."""
    empty = dict.fromkeys(_FIELDS)
    if source is None:
        return empty
    try:
        record = ast.literal_eval(source)
        if not isinstance(record, dict):
            return empty
        return {name: _as_text(record.get(name)) for name in _FIELDS}
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return empty


# Declared nondeterministic to be evaluated once: a filter on a field would else
# be pushed below the projection together with a second copy of the call.
@F.pandas_udf(_RECORD)
def _literal_fields(source: pd.Series) -> pd.DataFrame:
    fields = pd.DataFrame(None, index=source.index, columns=list(_FIELDS), dtype=object)
    given = source[source.notna()]
    if len(given):
        fields.loc[given.index] = [list(read_literal(s).values()) for s in given]
    return fields


_literal_fields = _literal_fields.asNondeterministic()


def with_literal_fields(df: DataFrame, column: str) -> DataFrame:
    """Adds ``class``, ``polarity`` and ``subjectivity`` as strings.

    Plain records are read by a regular expression in the JVM. Python sees the
    others only: for a plain row it is handed a null and returns at once.
    """
    source = F.col(column)
    parts = F.split(F.regexp_replace(source, CANONICAL, "$1\x01$2\x01$3"), "\x01")
    # The call takes _cut, which therefore is computed once, ahead of it.
    steps = df.withColumn("_cut", F.when(source.rlike(CANONICAL), parts)).withColumn(
        "_slow", _literal_fields(F.when(F.col("_cut").isNull(), source))
    )

    def field(i: int, name: str) -> Column:
        part = F.col("_cut")[i]
        fast = part if name == "class" else F.when(part != "None", part)
        slow = F.col(f"_slow.{name}")
        return F.when(F.col("_cut").isNotNull(), fast).otherwise(slow).alias(name)

    return steps.select(*df.columns, *[field(i, name) for i, name in enumerate(_FIELDS)])


def to_number(text: Column) -> Column:
    """String to double, null if it is none."""
    return F.when(text.rlike(_DECIMAL) | text.rlike(_INFINITE), text.try_cast("double"))
