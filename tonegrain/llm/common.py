"""Helpers shared by the corpus operators: tables, staging, text to hashed words.

Text reaches Python as UTF-8 bytes. ``bytes.lower`` lower-cases A-Z only and
``bytes.split`` splits on ``[\\x20\\x09-\\x0D]``, which are the rules the operators need.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegrain.sources.staging import stage

__all__ = ["blob", "fold", "looked_up", "mix64", "ngram_hashes", "packed", "sampled", "stage", "table", "word_hashes", "ALNUM"]

# The finaliser of MurmurHash3 for 64 bits.
_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_INSIDE = np.array([b not in SPACES for b in range(256)])

#: For ``bytes.translate``: every ASCII byte but letters and digits becomes a space.
ALNUM = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blob(text: str | Column) -> Column:
    """The UTF-8 bytes of a text column; null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(text, F.lit("")).cast("binary")


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id gives fold 0."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def packed(df: DataFrame, rows: int, per_task: int = 200_000) -> DataFrame:
    """``df`` in about one partition per ``per_task`` of ``rows``, for narrow tables of known size.

    Spares small tables hundreds of tiny files; never raises the number of partitions.
    """
    return df.coalesce(rows // per_task + 1)


def sampled(order: Column, rows: int, total: int) -> Column:
    """Whether a row of 64-bit hash ``order`` is among about ``rows`` of ``total`` rows."""
    return F.pmod(order, F.lit(1 << 40)) < F.lit(min(1 << 40, (rows << 40) // max(total, 1) + 1))


#: Keys with more than one in this many rows are looked up by a broadcast.
NARROW = 10_000


def looked_up(df: DataFrame, lines: DataFrame, key: str, total: int) -> DataFrame:
    """``df`` with the line of its ``key``; ``lines`` says in ``n`` how many of ``total`` rows a key has.

    Lines of frequent keys (fewer than ``NARROW``) are broadcast and their rows stay where they are;
    the other rows join by shuffle, where no key is large. ``lines`` is read three times, ``df`` twice.
    """
    often = F.col("n") * NARROW > total
    heavy, light = lines.filter(often).drop("n"), lines.filter(~often).drop("n")
    of_light = df.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key)
    return df.join(F.broadcast(heavy), key).unionByName(of_light)


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _S33)
    x = x * _C1
    x = x ^ (x >> _S33)
    x = x * _C2
    return x ^ (x >> _S33)


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWER = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWER
    if _POWER.size < n:
        size = 1 << max(6, (n - 1).bit_length())
        factors = np.full(size, 0xD6E8FEB86659FD93, np.uint64)
        factors[0] = 1
        _POWER = np.cumprod(factors, dtype=np.uint64)
    return _POWER


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash for each run of bytes other than white space, in order."""
    raw = np.frombuffer(data, np.uint8)
    inside = _INSIDE[raw]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    if not edges.size:
        return np.empty(0, np.uint64)
    lengths = edges[1::2] - edges[0::2]
    first = np.cumsum(lengths) - lengths
    chars = raw[inside]
    place = np.arange(chars.size) - np.repeat(first, lengths)
    value = _BYTE[chars] * _powers(int(lengths.max()))[place]
    return mix64(np.add.reduceat(value, first) + lengths.astype(np.uint64))


def ngram_hashes(words: np.ndarray, n: int, step: int = 1) -> np.ndarray:
    """Hashes of all ``n`` words ``step`` apart; empty if the text is shorter."""
    size = words.size - (n - 1) * step
    if size <= 0:
        return np.empty(0, np.uint64)
    out = np.full(size, n * 131 + step, np.uint64)
    for i in range(n):
        out = mix64(out * _C2 + words[i * step : i * step + size])
    return out
