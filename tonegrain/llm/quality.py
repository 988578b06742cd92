"""Quality filter: calibrated logistic regression on hashed word and character n-grams.

Features of a text are its words, word pairs and its 4-grams and 5-grams of characters (code
points), hashed to ``2**BITS`` places per kind. A text's value at a place is
its count over the text's length, so long and short texts compare. AdaGrad, a row at
a time, fits the weights on shards of the labelled rows, in parallel; every shard
leaves one fifth of its rows out and scores them, and Platt scaling on all rows left
out turns margins into probabilities. Texts are scored in Arrow batches and kept if
they break no counting rule and their probability is at least ``KEEP``.

The fit reads at most ``max_rows`` labelled rows, the ones of smallest id hash.

Counting rules (words are ``[^\\x20\\x09-\\x0D]+``): fewer than 50 words, or more
than half of the words inside 3-word windows that occur again in the text.

Defined results: null and empty texts have no words and fail the rules; repeated rows
get equal results; an id with several label rows counts as good if any says so; null
labels are not learnt from; without labelled rows of both kinds the probability is 1
and the rules decide alone. Other columns are ignored whatever their names are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegrain.llm.common import blob, mix64, ngram_hashes, stage, word_hashes
from tonegrain.llm.toxicity import labelled_sample

BITS = 16
KINDS = 4
MAX_ROWS = 8_000
SHARDS = 4
EPOCHS = 6
RATE, L2 = 0.5, 1e-6
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
KEEP = 0.2

_STEP = np.uint64(0x9E3779B97F4A7C15)

# The characters counted as symbols.
SYMBOLS = b"#*$%&|<>"

RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, probability double"
)


@dataclass(frozen=True)
class Model:
    """Dense weights of all kinds, their bias, and the two Platt parameters."""

    weight: np.ndarray
    bias: float
    slope: float
    offset: float


def _char_ngrams(chars: np.ndarray, n: int) -> np.ndarray:
    size = chars.size - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    out = chars[:size].copy()
    for i in range(1, n):
        out = out * _STEP + chars[i : i + size]
    return mix64(out + np.uint64(n))


def places(data: bytes, words: np.ndarray | None = None) -> list[np.ndarray]:
    """Hashed places by kind, repeats included."""
    words = word_hashes(data) if words is None else words
    shift = np.uint64(64 - BITS)
    chars = np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    kinds = [words, ngram_hashes(words, 2), _char_ngrams(chars, 4), _char_ngrams(chars, 5)]
    return [(h >> shift).astype(np.int64) + (k << BITS) for k, h in enumerate(kinds)]


def margin(parts: list[np.ndarray], weight: np.ndarray, bias: float) -> float:
    return bias + sum(float(weight[p].mean(dtype=np.float64)) for p in parts if p.size)


def _rows(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places and their shares."""
    index, value = [], []
    for p in parts:
        if p.size:
            u, n = np.unique(p, return_counts=True)
            index.append(u)
            value.append(n / p.size)
    return (np.concatenate(index), np.concatenate(value)) if index else (np.empty(0, np.int64), np.empty(0))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """AdaGrad, one row at a time; both labels weigh the same in total."""
    w, g2 = np.zeros(KINDS << BITS), np.full(KINDS << BITS, 1e-8)
    bias, gb2 = 0.0, 1e-8
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3) if len(labels) else 0.5
    for _ in range(epochs):
        for (index, value), y in zip(rows, labels, strict=True):
            m = float(w[index] @ value) + bias
            g = (1.0 / (1.0 + np.exp(-np.clip(m, -35, 35))) - y) * (0.5 / share if y else 0.5 / (1 - share))
            step = g * value + L2 * w[index]
            g2[index] += step * step
            w[index] -= RATE * step / np.sqrt(g2[index])
            gb2 += g * g
            bias -= 0.1 * RATE * g / np.sqrt(gb2)
    return w, bias


def platt(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through (margin, label), by Newton's method."""
    if len(set(labels.tolist())) < 2:
        return 1.0, 0.0
    good, bad = labels.sum(), (1 - labels).sum()
    aim = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.column_stack([margins, np.ones_like(margins)])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -35, 35)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (aim - p) - 1e-3 * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return max(float(beta[0]), 1e-6), float(beta[1])


def _learn(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["_order", "_id"], kind="stable")
    rows = [_rows(places(t)) for t in group["_text"]]
    labels = group["_label"].to_numpy(float)
    out = np.arange(len(rows)) % 5 == 4
    train = np.flatnonzero(~out)
    w, bias = fit([rows[i] for i in train], labels[train])
    kept = np.flatnonzero(w)
    held = np.flatnonzero(out)
    margins = np.array([float(w[rows[i][0]] @ rows[i][1]) + bias for i in held])
    # Rows are tagged by their place: a weight, -1 the bias, -2 and -3 a bad or good row left out.
    return pd.DataFrame(
        {"place": np.concatenate([kept, [-1], -2 - labels[held].astype(int)]), "value": np.concatenate([w[kept], [bias], margins])}
    )


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, shards: int = SHARDS) -> Model | None:
    """Fit on label rows ``(doc_id, quality)``; None without rows of both kinds."""
    sample = labelled_sample(docs, labels, "quality", F.lit(True), max_rows)
    fits = stage(
        sample.withColumn("_shard", F.pmod(F.xxhash64(F.lit(9), "_id"), F.lit(shards)))
        .groupBy("_shard")
        .applyInPandas(_learn, "place long, value double"),
        "quality-fits",
    )
    # To the driver: at most KINDS x 2**BITS weights, and max_rows margins.
    sums = fits.filter("place >= -1").groupBy("place").agg(F.sum("value").alias("value"), F.count("*").alias("n")).toPandas()
    held = fits.filter("place <= -2").toPandas()
    bias = sums[sums["place"] == -1]
    if bias.empty or held["place"].nunique() < 2:
        return None
    learners = int(bias["n"].iloc[0])
    sums = sums[sums["place"] >= 0]
    weight = np.zeros(KINDS << BITS, np.float32)
    weight[sums["place"].to_numpy()] = sums["value"].to_numpy() / learners
    held = held.sort_values(["place", "value"])
    slope, offset = platt(held["value"].to_numpy(), (held["place"] == -3).to_numpy(float))
    return Model(weight, float(bias["value"].iloc[0]) / learners, slope, offset)


def _repeated(words: np.ndarray) -> int:
    """Words inside 3-word windows that occur at least twice."""
    grams = ngram_hashes(words, 3)
    if grams.size < 2:
        return 0
    _, inverse, counts = np.unique(grams, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(counts[inverse] > 1)
    covered = np.zeros(words.size, bool)
    for i in range(3):
        covered[hit + i] = True
    return int(covered.sum())


def _dup_lines(data: bytes) -> int:
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def counts(data: bytes, words: np.ndarray) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, words in repeated windows."""
    solid = data.translate(None, b"\x20\x09\x0a\x0b\x0c\x0d")
    raw = np.frombuffer(solid, np.uint8)
    chars = int(np.count_nonzero((raw & 0xC0) != 0x80))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    return words.size, chars, symbols, _dup_lines(data), _repeated(words)


def measure(text: Column, model: Model | None, df: DataFrame) -> Column:
    """Struct column of :data:`RESULT` over ``df``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            rows = []
            for data in texts:
                words = word_hashes(data)
                p = 1.0
                if m is not None:
                    logit = m.slope * margin(places(data, words), m.weight, m.bias) + m.offset
                    p = 1.0 / (1.0 + np.exp(-np.clip(logit, -35, 35)))
                rows.append((*counts(data, words), p))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in RESULT.split(", ")])

    return rate(blob(text))


def failed() -> Column:
    """The counting rules, on the columns of :data:`RESULT`."""
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )


def apply(docs: DataFrame, model: Model | None, keep: float = KEEP) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``probability`` and ``kept`` for every row."""
    rated = docs.select("doc_id", measure(F.col("text"), model, docs).alias("_r")).select("doc_id", "_r.*")
    rated = rated.withColumn("base_failed", failed())
    return rated.withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= keep))
