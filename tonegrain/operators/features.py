"""TF-IDF as relations: terms, counts, document frequencies, weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonegrain.functions.text import terms

# A term table up to this size is broadcast; a larger one is joined by shuffle,
# but for the terms heavy enough to skew it.
BROADCAST_BYTES = 64 * 1024 * 1024

# What a broadcast line takes beside its term.
_LINE_BYTES = 96

# Terms holding over 1/HEAVY_SHARE of all occurrences are heavy: fewer than HEAVY_SHARE,
# and their hashes fit a broadcast whatever their length.
HEAVY_SHARE = 100_000

# Text that one task splits into terms, and lines that one task joins; left to itself, Spark deals a
# table out by the number of cores, however long it is.
TASK_BYTES = 4 * 1024 * 1024
TASK_LINES = 1_000_000


def tokenize(df: DataFrame, column: str = "input_text") -> DataFrame:
    return df.withColumn("tokens", terms(column))


def ngrams(df: DataFrame, ngram_max: int = 2, column: str = "input_text") -> DataFrame:
    """Tokens and the n-grams of neighbouring tokens up to ``ngram_max``."""
    return df.withColumn("terms", terms(column, ngram_max))


def term_count(
    df: DataFrame, ngram_max: int = 1, column: str = "input_text", keep_empty: bool = False
) -> DataFrame:
    """Occurrences per (row_id, term).

    The texts are partitioned by ``row_id`` before they are split, so grouping the
    terms needs no exchange: whole texts travel instead of one line per term. There is a
    partition for every ``TASK_BYTES`` of text, so the counts of one task are bounded;
    their size is an action, so ``df`` is read twice: stage it.
    ``keep_empty`` gives a document without terms one line with a null term.
    """
    explode = F.explode_outer if keep_empty else F.explode
    size = df.agg(F.sum(F.octet_length(column).cast("bigint"))).first()[0] or 0
    return (
        df.select("row_id", column)
        .repartition(size // TASK_BYTES + 1, "row_id")
        .select("row_id", explode(terms(column, ngram_max)).alias("term"))
        .groupBy("row_id", "term")
        .agg(F.count("*").alias("tf"))
    )


def doc_freq(df: DataFrame, ngram_max: int = 1, column: str = "input_text") -> DataFrame:
    """Documents per term; each document names a term once, so no count per text."""
    return (
        df.select(F.explode(F.array_distinct(terms(column, ngram_max))).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("df"))
    )


def vocab_prune(
    frequencies: DataFrame, documents: DataFrame, min_df: int = 5, max_df: float = 0.8
) -> DataFrame:
    """Terms in at least ``min_df`` documents and at most a share of ``max_df``.

    Adds the number of documents as ``n``.
    """
    n = documents.agg(F.count("*").alias("n")).scalar()
    return (
        frequencies.withColumn("n", n)
        .filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * F.col("n")))
    )


def idf(vocab: DataFrame) -> DataFrame:
    """Adds ``idf = ln((1 + n) / (1 + df)) + 1``."""
    return vocab.withColumn("idf", F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)


def fit_vocabulary(
    df: DataFrame,
    ngram_max: int = 1,
    min_df: int = 5,
    max_df: float = 0.8,
    column: str = "input_text",
) -> DataFrame:
    """Term, document frequency and idf of a corpus (lazy)."""
    return idf(vocab_prune(doc_freq(df, ngram_max, column), df, min_df, max_df)).select(
        "term", "df", "idf"
    )


def fits_broadcast(table: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a staged term table is small enough to broadcast (an action)."""
    size = F.sum(F.octet_length("term") + _LINE_BYTES)
    return (table.agg(size.alias("size")).first()["size"] or 0) <= limit


def join_terms(counts: DataFrame, table: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    """Join of (row_id, term, ...) with a staged term table holding ``df``; each side is scanned once.

    A small table is broadcast and the ``row_id`` partitioning of ``counts`` stays. Otherwise both sides shuffle by
    (term, slice): a heavy term has as many slices as its share of all occurrences asks for, its line is
    repeated for each, and rows go to a slice by ``row_id``. All heavy lines together are
    repeated less than 2 * HEAVY_SHARE times. What is broadcast is a hash per heavy term; two terms of one hash
    share the larger number of slices. Null terms (``how="left"``) spread by ``row_id`` too. A frequent
    term that the table lacks is left to the split of skewed partitions at run time. A task joins about ``TASK_LINES``
    of the known lines (their number is an action), and the result comes back by ``row_id`` in as many partitions.
    """
    if small:
        return counts.join(F.broadcast(table), "term", how)
    total = table.agg(F.sum("df")).first()[0] or 1
    parts = total // TASK_LINES + 1
    share = F.col("df") * HEAVY_SHARE / F.lit(total)
    heavy = (
        table.filter(share > 1)
        .groupBy(F.xxhash64("term").alias("_hash"))
        .agg(F.max(F.ceil(share)).alias("_slices"))
    )

    def marked(side: DataFrame) -> DataFrame:
        return side.withColumn("_hash", F.xxhash64("term")).join(F.broadcast(heavy), "_hash", "left").drop("_hash")

    slices = F.when(F.col("term").isNull(), HEAVY_SHARE).otherwise(F.coalesce("_slices", F.lit(1)))
    rows = marked(counts).withColumn("_slice", F.pmod(F.xxhash64("row_id"), slices)).drop("_slices")
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), slices - 1))
    lines = marked(table).withColumn("_slice", every).drop("_slices")
    rows, lines = (side.repartition(parts, "term", "_slice") for side in (rows, lines))
    return rows.join(lines, ["term", "_slice"], how).drop("_slice").repartition(parts, "row_id")


def lookup_terms(
    counts: DataFrame, table: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, how: str = "inner"
) -> DataFrame:
    """:func:`join_terms`, by the measured size of the table (an action)."""
    return join_terms(counts, table, fits_broadcast(table, broadcast_bytes), how)


def tfidf(
    df: DataFrame,
    vocab: DataFrame,
    ngram_max: int = 1,
    column: str = "input_text",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Long table ``(row_id, term, weight)``, each document of L2 norm 1.

    A document without a known term has no line: its vector is zero. ``vocab``
    comes staged from :func:`fit_vocabulary`.
    """
    counts = term_count(df, ngram_max, column)
    hits = lookup_terms(counts, vocab.select("term", "df", "idf"), broadcast_bytes)
    raw = F.col("tf") * F.col("idf")
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("row_id")))
    return hits.select("row_id", "term", raw.alias("raw")).select(
        "row_id", "term", (F.col("raw") / norm).alias("weight")
    )


def grid_vocabulary(
    df: DataFrame,
    grid: Sequence[dict],
    column: str = "input_text",
) -> DataFrame:
    """Candidates of a parameter grid with the number of terms each would keep.

    One pass over the texts at the longest n-gram serves all candidates: a term's
    length in words tells which settings know it. ``grid`` lists the settings in
    candidate order.
    """
    longest = max(c["ngram_max"] for c in grid)
    n = df.agg(F.count("*").alias("n")).scalar()
    frequencies = (
        doc_freq(df, longest, column)
        .withColumn("words", F.regexp_count("term", F.lit(" ")) + 1)
        .withColumn("n", n)
    )

    def kept(c: dict):
        fits = (
            (F.col("words") <= c["ngram_max"])
            & (F.col("df") >= c["min_df"])
            & (F.col("df") <= F.lit(c["max_df"]) * F.col("n"))
        )
        return F.count(F.when(fits, True))

    counted = frequencies.agg(*[kept(c).alias(f"c{i}") for i, c in enumerate(grid)])
    lines = [
        F.struct(
            F.lit(i).cast("bigint").alias("candidate_id"),
            F.lit(c["max_iter"]).cast("bigint").alias("max_iter"),
            F.lit(c["max_df"]).alias("max_df"),
            F.lit(c["min_df"]).cast("bigint").alias("min_df"),
            F.lit(c["ngram_max"]).cast("bigint").alias("ngram_max"),
            F.col(f"c{i}").alias("n_terms"),
        )
        for i, c in enumerate(grid)
    ]
    return counted.select(F.inline(F.array(*lines)))
