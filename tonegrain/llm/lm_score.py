"""Language-model scores: a gated recurrent network over words, and the unigram base.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; every text closes with an end token (the
empty word). Spark counts the tokens of all training rows. The network (see ``recurrent``)
knows the ``WORDS`` most frequent tokens and one token for all others; what the state
says about "another word" is multiplied by that word's smoothed share among the others, so every
text has a probability. Class and word biases come from the counts of all
training rows; the other weights are learnt by truncated backpropagation from all training rows, in shards of
about ``SHARD_TOKENS`` tokens (``SHARDS`` of them at least) whose weights are averaged in Spark, by their tokens,
after each of ``ROUNDS`` rounds. Every row is learnt in one round at least; small tables are read again,
in as many rounds as it takes to learn ``LEAST_TOKENS``, at most in all. Texts are learnt and scored whole, the
state carried from window to window.

Counts of the words that ``KNOWN`` allows are broadcast (a bound on their number); counts of rarer
words are joined by word, after each text's copies of a word were put together.

Defined results: a null text is empty and has the end token alone; repeated rows get equal results;
a null id is in fold 0, like an id whose hash is; without training rows every count is 0 and
the score is the base score; other columns are ignored whatever their names are; an empty table
gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegrain.llm import recurrent
from tonegrain.llm.common import blob, stage

KNOWN = 200_000
WORDS = 4_000
SHARDS, ROUNDS = 4, 3
SHARD_TOKENS, LEAST_TOKENS = 1_500_000, 3_000_000
#: Weights of one array that are averaged together.
SLICE = 1 << 16
ADD = 0.1
#: Texts scored side by side, in bytes.
HELD_BYTES = 24_000_000
#: Texts split into words at once, in bytes.
PIECE_BYTES = 16_000_000

PARTS = (
    "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, "
    "words array<binary>, times array<int>"
)


def words_of(texts: pa.Array) -> pa.ListArray:
    """The words of each text, given in bytes, and the end token, an empty word."""
    # Arrow's ASCII functions know A-Z and the white space above alone. The space added leaves an empty word at the end.
    texts = pc.binary_join_element_wise(pc.ascii_lower(texts.view(pa.string())), "", " ")
    return pc.ascii_split_whitespace(pc.ascii_ltrim_whitespace(texts))


def _places(words: pa.ListArray, known: pa.Array) -> np.ndarray:
    """The place of each word in ``known``, words in bytes; -1 if it has none."""
    return pc.index_in(words.flatten(), known.view(pa.string())).fill_null(-1).to_numpy()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows, by ``PIECE_BYTES`` of the texts in their last column."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy(), dtype=np.int64)
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PIECE_BYTES, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in _pieces(batches):
        counts = pc.value_counts(words_of(piece.column(0)).flatten())
        yield pa.RecordBatch.from_arrays([counts.field("values").view(pa.binary()), counts.field("counts")], names=["word", "c"])


def count_tokens(docs: DataFrame) -> DataFrame:
    """``(word, c)`` over all rows of ``docs``; written once."""
    each = docs.select(blob("text").alias("text")).mapInArrow(_count, "word binary, c long")
    return stage(each.groupBy("word").agg(F.sum("c").alias("c")), "token-counts")


def frequent(counts: DataFrame, most: int = KNOWN) -> pd.DataFrame:
    """At most ``most`` words: all whose count is at least some number; by count, then word."""
    by_count = counts.groupBy((F.log2("c") * 64).cast("int").alias("band")).agg(F.count("*").alias("n")).toPandas()
    by_count = by_count.sort_values("band", ascending=False)
    fits = by_count[by_count["n"].cumsum() <= most]
    if fits.empty:
        return pd.DataFrame({"word": [], "c": []})
    known = counts.filter((F.log2("c") * 64).cast("int") >= int(fits["band"].min())).toPandas()
    known["word"] = known["word"].map(bytes)
    return known.sort_values(["c", "word"], ascending=[False, True], ignore_index=True)


def network_words(known: pd.DataFrame, most: int = WORDS) -> pd.DataFrame:
    """The frequent words, the network's ``most`` first; the end token is always one of those."""
    end = known.index[known["word"] == b""]
    if end.empty or end[0] < most:
        return known
    rest = known.drop(end[0])
    return pd.concat([rest.iloc[: most - 1], known.loc[end], rest.iloc[most - 1 :]], ignore_index=True)


def _mean(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """A slice of the weights, averaged over shards by their tokens."""
    total = 0.0
    for value, weight in zip(group["value"], group["weight"], strict=True):
        total = total + np.frombuffer(value, np.float32) * float(weight)
    mean = (total / group["weight"].sum()).astype(np.float32)
    return pd.DataFrame({"name": [key[0]], "part": [key[1]], "value": [mean.tobytes()]})


def _train(docs: DataFrame, known: pd.DataFrame, unknown: int) -> tuple[recurrent.Params, np.ndarray, int] | None:
    """Averaged weights, class bounds and the end token; ``unknown``: tokens not in ``known``."""
    top = known.head(WORDS)
    if b"" not in top["word"].tolist():
        return None
    counts = np.append(top["c"].to_numpy(float), known["c"].sum() - top["c"].sum() + unknown)
    starts = recurrent.class_starts(counts)
    end = int(np.flatnonzero((top["word"] == b"").to_numpy())[0])
    params = recurrent.initial(counts, starts)
    spark, n = docs.sparkSession, int(counts.sum())
    passes = min(ROUNDS, -(-LEAST_TOKENS // n))
    shards = max(SHARDS, -(-n * passes // (ROUNDS * SHARD_TOKENS)))
    words = spark.sparkContext.broadcast(pa.array(top["word"], pa.binary()))

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other = len(words.value)
        for piece in _pieces(batches):
            own = words_of(piece.column(2))
            ids = _places(own, words.value)
            ids = np.where(ids < 0, other, ids).astype(np.uint16)
            cuts = own.offsets.to_numpy() * np.int32(ids.itemsize)
            texts = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(cuts), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([*piece.columns[:2], texts], names=["doc_id", "order", "ids"])

    order = F.xxhash64(F.lit(13), F.col("doc_id").cast("long"), "text")
    texts = docs.select(F.col("doc_id").cast("long"), order.alias("order"), blob("text").alias("text"))
    texts = texts.mapInArrow(ids_of, "doc_id long, order long, ids binary").withColumns({
        "shard": F.pmod("order", F.lit(shards)), "turn": F.pmod(F.xxhash64(F.lit(17), "order"), F.lit(ROUNDS))
    })
    texts = stage(texts, "lm-texts")
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast((params, starts, end))

        def learn(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["order", "doc_id"])
            own = [np.frombuffer(x, np.uint16) for x in group["ids"]]
            tokens = np.concatenate([own[i] for i in np.random.default_rng(turn).permutation(len(own))])
            learner = recurrent.Learner(*shared.value)
            learner.fit(tokens)
            out = [
                (name, lo // SLICE, float(tokens.size), v.ravel()[lo : lo + SLICE].astype(np.float32).tobytes())
                for name, v in learner.p.items() for lo in range(0, v.size, SLICE)
            ]
            return pd.DataFrame(out, columns=["name", "part", "weight", "value"])

        now = texts.filter(F.pmod(F.lit(turn) - F.col("turn"), F.lit(ROUNDS)) < passes)
        learnt = now.repartitionByRange(shards, "shard").groupBy("shard").applyInPandas(learn, "name string, part long, weight double, value binary")
        got = learnt.groupBy("name", "part").applyInPandas(_mean, "name string, part long, value binary").toPandas()
        for name, own in got.groupby("name"):
            mean = np.concatenate([np.frombuffer(v, np.float32) for v in own.sort_values("part")["value"]])
            params[name] = mean.reshape(params[name].shape)
    return params, starts, end


def score(docs: DataFrame, learnable: Column, held_out: Column) -> DataFrame:
    """The columns of the module's contract for every row of ``docs(doc_id, text)``.

    ``learnable`` and ``held_out`` are conditions on the columns of ``docs``.
    """
    spark = docs.sparkSession
    counts = count_tokens(docs.filter(learnable))
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = int(total["n"] or 0), int(total["v"])
    known = network_words(frequent(counts))
    trained = _train(docs.filter(learnable), known, n - int(known["c"].sum()))
    words, kept = pa.array(known["word"], pa.binary()), min(WORDS, len(known)) if trained else 0
    modelled = int(known["c"].iloc[:kept].sum())
    all_mass = n + ADD * (v + 1)
    rest_mass = (n - modelled) + ADD * (v - kept + 1)  # all_mass if there is no network
    shared = spark.sparkContext.broadcast((words, known["c"].to_numpy(float), trained, kept))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, c, net, kept = shared.value
        logs = np.append(np.log10(c + ADD), 0.0)
        schema = pa.schema(
            [("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
             ("base", pa.float64()), ("model", pa.float64()), ("words", pa.list_(pa.binary())), ("times", pa.list_(pa.int32()))]
        )
        parts: list[tuple] = []
        tokens: list[np.ndarray] = []

        def finish() -> Iterator[pa.RecordBatch]:
            more = np.zeros(sum(len(p[0]) for p in parts))
            if net is not None:
                params, starts, end = net
                more = recurrent.score_texts(params, starts, tokens, end) / np.log(10)
            for *own, model, words, times in parts:
                model, more = model + more[: model.size], more[model.size :]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([*own, model, words, times], schema)], schema=schema)
            parts.clear()
            tokens.clear()

        held = 0
        for piece in _pieces(batches):
            own = words_of(piece.column(3))
            cuts, ids = own.offsets.to_numpy(), _places(own, words)
            size, rare = np.diff(cuts), ids < 0
            beyond = rare | (ids >= kept)
            # Every text has a token.
            n_rare, n_beyond = (np.add.reduceat(x, cuts[:-1], dtype=np.int64) for x in (rare, beyond))
            found = logs[ids]
            base = [found[a:b].sum() for a, b in pairwise(cuts.tolist())]
            left, ends = found[beyond], np.cumsum([0, *n_beyond]).tolist()
            model = np.array([left[a:b].sum() for a, b in pairwise(ends)]) - n_beyond * np.log10(rest_mass)
            # A text's copies of a rare word are put together.
            coded = own.flatten().filter(pa.array(rare)).dictionary_encode()
            kinds = max(1, len(coded.dictionary))
            pairs, times = np.unique(np.repeat(np.arange(len(own)), n_rare) * kinds + coded.indices.to_numpy(), return_counts=True)
            first = pa.array(np.searchsorted(pairs, np.arange(len(own) + 1) * kinds), pa.int32())
            parts.append((
                *piece.columns[:3], size, size - n_rare, base, model,
                pa.ListArray.from_arrays(first, coded.dictionary.take(pa.array(pairs % kinds)).view(pa.binary())),
                pa.ListArray.from_arrays(first, pa.array(times, pa.int32())),
            ))
            if net is not None:
                tokens += np.split(np.where(beyond, kept, ids).astype(np.uint16), cuts[1:-1])
            held += piece.column(3).nbytes + 200 * len(own)
            if held > HELD_BYTES:
                yield from finish()
                held = 0
        if parts:
            yield from finish()

    own = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), held_out.alias("held_out"), blob("text").alias("text")
    )
    parts = stage(own.mapInArrow(measure, PARTS), "lm-parts")
    rare = parts.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    seen = counts.select("word", "c")
    added = (
        rare.join(seen, "word", "left").groupBy("row").agg(
            F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + ADD)).alias("more"),
            F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
        )
    )
    return parts.drop("words", "times").join(added, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(all_mass)))).alias("base_score"),
        (F.col("model") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )
