"""From raw documents to packed training sequences.

Stages, in order: toxic documents go; one document of each near-duplicate group stays;
personal data is replaced; sources are mixed to target weights; texts are packed. Each
stage reads what its predecessor kept as Parquet. All but the last return the columns of
``documents``; the last returns the pieces of ``packing.pack``.

Nulls, empty texts, repeated rows, empty tables and extra columns are treated as the
operators' modules state; no stage drops a document for them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegrain.llm import mixing, near_dup, packing, pii, toxicity
from tonegrain.llm.common import fold, stage, table

TOXIC = 0.5
TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below ``TOXIC``; the model is learnt from the labels outside the test fold."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold("_id", 5) != 0)
    return docs.filter(toxicity.score(F.col("text"), model, docs) < TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of smallest id."""
    return near_dup.keep_first(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in the text replaced by its kind, and lengths to match."""
    clean = pii.redact(docs)
    if "n_chars" not in clean.columns:
        return clean
    length = F.coalesce(F.length("text"), F.col("n_chars")).cast(clean.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", length)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: some documents more than once, some not at all."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every document of the mix."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The fitted model, the hashed draws and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
