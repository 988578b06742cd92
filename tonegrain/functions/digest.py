"""Fixed-width keys for long texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_digest(*columns: str) -> Column:
    """SHA-256 over the columns, null told apart from every string.

    Each value is written with its length, so different rows never spell the same
    string. Grouping on 32 bytes keeps whole texts out of the shuffle.
    """
    parts = [
        F.coalesce(
            F.concat(F.octet_length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-")
        )
        for c in columns
    ]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def seeded_hash(seed: int, key: str) -> Column:
    """Hex digest giving every key its place in a seeded shuffle order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
