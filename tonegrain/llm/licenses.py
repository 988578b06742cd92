"""License scan by diagonal voting of word k-grams.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased. Templates are phrases and
notices (:data:`TEMPLATES`, a parameter). The hashes of all word pairs and triples of every text are
joined to the places those hashes have in the templates; the template side is as large as
the parameter and is broadcast. A hit counts once its words equal the template's.

A hit at word ``p`` of a text and word ``t`` of a template votes for the diagonal ``p - t``. Votes are
counted per text, template and diagonal; diagonals up to ``GAP`` words apart are merged,
as words are added or left out in a copy. A span is verified by the share of the template's
k-grams that it holds: phrases need all of them, notices ``SHARE``.

Long texts travel in pieces of ``PIECE`` words that overlap, so no row grows with its text.

Defined results: a null text is empty; texts without words have no place and score 0; repeated rows
get equal results; null ids are carried through; other columns are ignored whatever their
names are; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonegrain.llm.common import ALNUM, blob, ngram_hashes, stage, word_hashes

PIECE = 1024
GAP = 8
SHARE = 0.5
#: Joins the row that carries a text's word count to a template of its own.
HEADER = -1

# Phrase and label.
PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

# Notices of widely used licenses, and the label each gives.
NOTICES = (
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2.0", "apache-2.0"),
    ("licensed under cc by nc 4.0", "cc-by-nc"),
    ("licensed under cc by sa 4.0", "cc-by-sa"),
    ("licensed under the mozilla public license version 2.0", "mpl"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files the software to deal in the software without restriction",
        "mit",
    ),
    (
        "licensed under the apache license version 2.0 the license you may not use this file except in "
        "compliance with the license you may obtain a copy of the license at",
        "apache-2.0",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted "
        "provided that the following conditions are met",
        "bsd",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu "
        "general public license as published by the free software foundation",
        "gpl",
    ),
    (
        "this source code form is subject to the terms of the mozilla public license v 2.0",
        "mpl",
    ),
)

TEMPLATES = tuple((t, label, True) for t, label in PHRASES) + tuple((t, label, False) for t, label in NOTICES)

HITS = "row long, doc_id long, n_words long, start long, n_pairs int, text string, keys array<long>"


def split_words(data: bytes) -> list[bytes]:
    return data.lower().translate(ALNUM).split()


def template_table(spark: SparkSession, templates: tuple = TEMPLATES) -> DataFrame:
    """A line per k-gram of a template: its hash, words, place, and what the template is."""
    lines = [(HEADER, -1, "", 0, "", False, 2, 1)]
    for i, (text, label, base) in enumerate(templates):
        words = split_words(text.encode())
        k = 2 if len(words) < 3 else 3
        hashes = ngram_hashes(word_hashes(b" ".join(words)), k).astype("int64").tolist()
        lines += [
            (h, i, label, at, b" ".join(words[at : at + k]).decode(), base, k, len(hashes)) for at, h in enumerate(hashes)
        ]
    return spark.createDataFrame(
        lines, "key long, template int, label string, at long, gram string, base boolean, k int, grams int"
    )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("start", pa.int64()),
         ("n_pairs", pa.int32()), ("text", pa.string()), ("keys", pa.list_(pa.int64()))]
    )
    for batch in batches:
        out, held = [], 0
        for row, doc_id, text in zip(*batch.columns, strict=True):
            row, doc_id = row.as_py(), doc_id.as_py()
            words = split_words(text.as_py())
            out.append((row, doc_id, len(words), 0, 1, "", [HEADER]))
            if not words:
                continue
            hashes = word_hashes(b" ".join(words))
            pairs, triples = (ngram_hashes(hashes, k).astype("int64") for k in (2, 3))
            for lo in range(0, len(words), PIECE):
                two, three = pairs[lo : lo + PIECE].tolist(), triples[lo : lo + PIECE].tolist()
                if two:
                    piece = b" ".join(words[lo : lo + PIECE + 2]).decode("utf-8", "replace")
                    out.append((row, None, None, lo, len(two), piece, two + three))
                    held += PIECE
            if held > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def hits(docs: DataFrame, templates: tuple = TEMPLATES) -> DataFrame:
    """A header per text and a line per verified k-gram hit; written once."""
    table = F.broadcast(template_table(docs.sparkSession, templates))
    pieces = (
        docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), blob("text").alias("text"))
        .mapInArrow(_pieces, HITS)
    )
    places = pieces.select("row", "doc_id", "n_words", "start", "n_pairs", "text", F.posexplode("keys").alias("i", "key"))
    place = F.col("i") - F.when(F.col("k") == 3, F.col("n_pairs")).otherwise(0)
    words = F.array_join(F.slice(F.split("text", " "), place + 1, F.col("k")), " ")
    same = (F.col("template") < 0) | (words == F.col("gram"))
    found = places.join(table, "key").filter(same)
    return stage(
        found.select("row", "doc_id", "n_words", "template", "label", "base", "grams", "at", (F.col("start") + place).alias("place")),
        "license-hits",
    )


def spans(found: DataFrame, share: float = SHARE, gap: int = GAP) -> DataFrame:
    """Verified spans of :func:`hits`: ``row, label, base, start, score``."""
    votes = found.filter("template >= 0").withColumn("diagonal", F.col("place") - F.col("at"))
    by = ["row", "template", "label", "base", "grams"]
    lines = votes.groupBy(*by, "diagonal").agg(F.count("*").alias("votes"))
    phrases = lines.filter("base and votes = grams").select("row", "label", "base", F.col("diagonal").alias("start"), F.lit(1.0).alias("score"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > gap, F.lit(True))
    merged = lines.filter("not base").withColumn("apart", apart.cast("long")).withColumn("band", F.sum("apart").over(order))
    notices = (
        votes.filter("not base").join(merged.select("row", "template", "diagonal", "band"), ["row", "template", "diagonal"])
        .groupBy(*by, "band").agg(F.min("diagonal").alias("start"), F.count_distinct("at").alias("covered"))
        .withColumn("score", F.col("covered") / F.col("grams")).filter(F.col("score") >= share)
        .select("row", "label", "base", "start", "score")
    )
    return phrases.union(notices)


def scan(docs: DataFrame, templates: tuple = TEMPLATES) -> DataFrame:
    """Per row: word count, base places, labels and score; see the module's text."""
    found = hits(docs, templates)
    headers = found.filter("template < 0").select("row", "doc_id", "n_words")
    per_text = spans(found).groupBy("row").agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
    )
    return headers.join(per_text, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
