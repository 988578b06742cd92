"""Near-duplicate texts: min-max hashing, banding, exact checks, components.

A text is the set of its distinct 5-word shingles (words ``[^\\x20\\x09-\\x0D]+``, A-Z
lower-cased; shorter texts are one shingle). ``PERMUTATIONS`` hash functions are
evaluated once per shingle and both the smallest and the largest value are kept, so half
as many evaluations give a signature of the same length. A band joins two minima and two
maxima of different functions; texts that agree in a band are candidates. Two texts of
similarity 0.75 miss all of the ``BANDS`` bands with probability 5e-6.

Texts of equal sets are one class first. Then, without forming all pairs of a bucket:

1. every class is compared to the smallest class of each of its buckets;
2. what is linked forms components; in a bucket that still holds several components, the
   rows outside its largest component are compared to the rows of the other components, in
   blocks of rows that share a largest component; a task emits the links it finds, not the pairs.

So every candidate pair is compared or known to be connected already. A comparison is
skipped only if the set sizes rule a link out, or the signatures differ in more than
``MOST_DIFFERENT`` of 128 places (5 standard deviations above the mean at similarity
0.75). All links are confirmed on the full shingle sets of both texts.

Defined results: null texts and texts without words have an empty set, link with
nothing and form their own component; repeated rows are one component, of which one row is
``first``; a null id counts as larger than any other, and a component of null ids only has a
null id; other columns are ignored whatever their names are; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegrain.llm.common import blob, looked_up, mix64, ngram_hashes, packed, stage, word_hashes
from tonegrain.llm.graph import components

SHINGLE = 5
PERMUTATIONS, BANDS = 64, 32
LINK_PERCENT = 75
MOST_DIFFERENT = 46
BLOCK = 256

_RNG = np.random.default_rng(20240607)
_A = (_RNG.integers(0, 1 << 32, PERMUTATIONS, np.uint32) | np.uint32(1))[:, None]
_B = _RNG.integers(0, 1 << 32, PERMUTATIONS, np.uint32)[:, None]
_MINIMA = np.arange(PERMUTATIONS).reshape(BANDS, 2)
_MAXIMA = (_MINIMA + PERMUTATIONS // 2) % PERMUTATIONS

SKETCH = (
    "doc_id long, k1 long, k2 long, n_shingles long, digest binary, bands array<long>, "
    "s0 long, s1 long, s2 long, s3 long"
)
SIGNS = ("s0", "s1", "s2", "s3")


def shingles(data: bytes, n: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text."""
    words = word_hashes(data.lower())
    if not words.size:
        return words
    return np.unique(ngram_hashes(words, min(n, words.size)))


def min_max(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value under each permutation of the 32-bit numbers."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    for i in range(0, x.size, 1024):
        values = x[i : i + 1024] * _A + _B
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    return low, high


def band_keys(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    parts = np.concatenate([low[_MINIMA], high[_MAXIMA]], axis=1).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(parts.shape[1]):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, i])
    return key.astype(np.int64)


def signs(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Two bits of each of the 128 values, in four longs."""
    two = mix64(np.concatenate([low, high]).astype(np.uint64)) & np.uint64(3)
    shifted = two.reshape(4, 32) << (np.uint64(2) * np.arange(32, dtype=np.uint64))
    return np.bitwise_or.reduce(shifted, axis=1).astype(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, digest, bands, sign = [], [], [], []
        for text in batch.column(3):
            own = shingles(text.as_py())
            n.append(own.size)
            if own.size:
                low, high = min_max(own)
                digest.append(xxhash.xxh3_128_digest(own.tobytes()))
                bands.append(band_keys(low, high))
                sign.append(signs(low, high).tolist())
            else:
                digest.append(None)
                bands.append(None)
                sign.append([0] * 4)
        columns = list(zip(*sign, strict=True)) if sign else [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
             *[pa.array(c, pa.int64()) for c in columns]],
            names=[f.split()[0] for f in SKETCH.split(", ")],
        )


def _keyed(docs: DataFrame) -> DataFrame:
    """Id, text, and two hashes of both: rows that agree in them are the same row to us."""
    own = docs.select(F.col("doc_id").cast("long"), blob("text").alias("text"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return own.select("doc_id", F.xxhash64(name, "text").alias("k1"), F.xxhash64("text", F.lit(5)).alias("k2"), "text")


def _similar(a: str, b: str) -> Column:
    """Whether sizes and signatures allow a link between the classes named by the prefixes."""
    different = F.lit(0)
    for s in SIGNS:
        x = F.col(a + s).bitwiseXOR(F.col(b + s))
        either = x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        different = different + F.bit_count(either)
    small, large = F.least(a + "n", b + "n"), F.greatest(a + "n", b + "n")
    return (small * 100 >= large * LINK_PERCENT) & (different <= MOST_DIFFERENT)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Exact rule on two sorted sets of distinct hashes."""
    both = np.intersect1d(a, b, assume_unique=True).size
    return 100 * both >= LINK_PERCENT * (a.size + b.size - both) and both > 0


def _confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    last, own = None, np.empty(0, np.uint64)
    for batch in batches:
        keep = []
        for center, text_a, text_b in zip(batch["b"], batch["text_a"], batch["text_b"], strict=True):
            if center != last:
                last, own = center, shingles(text_b)
            keep.append(linked(shingles(text_a), own))
        yield batch.loc[keep, ["a", "b"]]


def _texts(needed: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``(rep, text)`` for the classes in ``needed(rep)``."""
    keys = needed.join(classes.select("rep", "k1", "k2"), "rep")
    return _keyed(docs).join(keys, ["k1", "k2"]).select("rep", "text").dropDuplicates(["rep"])


def _sets(texts: pd.Series) -> pd.Series:
    return pd.Series([shingles(t).tobytes() for t in texts])


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` whose texts link."""
    pairs = stage(pairs, "pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    texts = stage(_texts(needed, classes, docs), "texts")
    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return stage(both.mapInPandas(_confirm, "a long, b long"), "links")


def _in_blocks(rows: DataFrame, meet: callable, schema: str) -> DataFrame:
    """Compare, for each ``main``, the rows of other components to all its rows, block by block.

    A block holds about ``BLOCK`` rows; each pair of blocks is one group of its own, so a large
    ``main`` is many groups of bounded size.
    """
    sizes = rows.groupBy("main").agg(
        F.count("*").alias("all"), F.count_if(F.col("comp") != F.col("main")).alias("outer")
    ).select("main", F.ceil(F.col("all") / BLOCK).alias("wide"), F.ceil(F.col("outer") / BLOCK).alias("tall"))
    dealt = rows.join(sizes, "main")
    own = F.xxhash64("rep")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    left = dealt.filter("comp <> main").withColumns({"x": F.pmod(own, F.col("tall")), "left": F.lit(True)}).withColumn("y", every("wide"))
    right = dealt.withColumns({"y": F.pmod(own, F.col("wide")), "left": F.lit(False)}).withColumn("x", every("tall"))
    both = left.unionByName(right).drop("wide", "tall").repartition("main", "x", "y")
    return both.sortWithinPartitions("main", "x", "y", "left", "rep").mapInPandas(partial(_blocks, meet=meet), schema)


def _blocks(batches: Iterator[pd.DataFrame], meet: callable) -> Iterator[pd.DataFrame]:
    """Call ``meet`` on each run of rows of one block pair; a run may span batches."""
    rest = None
    for batch in batches:
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        keys = batch[["main", "x", "y"]].to_numpy()
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        last = cuts[-1] if cuts.size else 0
        yield meet(batch.iloc[:last], np.concatenate([[0], cuts]))
        rest = batch.iloc[last:]
    if rest is not None:
        yield meet(rest, np.array([0, len(rest)]))


def _meet(exact: bool) -> callable:
    """Compare a block of rows to another: by size and signature, then, if ``exact``, by sets."""
    even, one = np.uint64(0x5555555555555555), np.uint64(1)

    def run(rows: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        main, rep, comp, n, is_left = (rows[c].to_numpy() for c in ("main", "rep", "comp", "n", "left"))
        sign = rows[list(SIGNS)].to_numpy().astype(np.uint64)
        sets = [np.frombuffer(x, np.uint64) for x in rows["set"]] if exact else []
        out: list[tuple[int, int]] = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            right = np.flatnonzero(~is_left[lo:hi]) + lo
            hit = np.zeros(right.size, bool)
            for i in np.flatnonzero(is_left[lo:hi]) + lo:
                ok = (comp[right] != comp[i]) & ((comp[right] == main[i]) | (rep[right] < rep[i]))
                ok &= np.minimum(n[right], n[i]) * 100 >= np.maximum(n[right], n[i]) * LINK_PERCENT
                x = sign[right] ^ sign[i]
                ok &= np.bitwise_count((x | (x >> one)) & even).sum(axis=1) <= MOST_DIFFERENT
                if not ok.any():
                    continue
                if not exact:
                    hit |= ok
                    out.append((main[i], rep[i]))
                    continue
                at, mine = right[ok], sets[i]
                flat = np.concatenate([sets[k] for k in at])
                found = mine[np.minimum(np.searchsorted(mine, flat), mine.size - 1)] == flat
                both = np.add.reduceat(found.astype(np.int64), np.cumsum(n[at]) - n[at])
                at = at[100 * both >= LINK_PERCENT * (n[at] + n[i] - both)]
                # One link to each component is enough to join them.
                out += [(rep[i], rep[k]) for k in at[np.unique(comp[at], return_index=True)[1]]]
            out += [(main[k], rep[k]) for k in right[hit]]
        return pd.DataFrame(out, columns=["a", "b"] if exact else ["main", "rep"], dtype="int64")

    return run


def sketches(docs: DataFrame) -> DataFrame:
    """One row per input row: ids, set size, set digest, band keys, signature bits; written once."""
    out = _keyed(docs).mapInArrow(_sketch, SKETCH).withColumn("row", F.monotonically_increasing_id())
    return stage(out, "sketches")


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, k1, k2, row, n_shingles, component_id, first`` for every row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest id reachable over links; ``first`` marks one row of each
    component, one with that id.
    """
    rows = sketches(docs)
    total = rows.count()
    filled = rows.filter("n_shingles > 0")
    # Of equal sets: the first row, how many, and the smallest id with the first row that has it.
    best = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    sets = filled.groupBy("digest").agg(F.min("row").alias("rep"), F.count("*").alias("n"), F.min(best).alias("best"))
    sets = stage(packed(sets, total, 100_000), "sets")
    classes = sets.select("rep").join(filled, F.col("rep") == F.col("row")).select(
        "rep", "k1", "k2", F.col("n_shingles").alias("n"), "bands", *SIGNS
    )
    classes = stage(packed(classes, total, 50_000), "classes")
    light = classes.select("rep", "n", *SIGNS)

    def named(prefix: str, key: str) -> DataFrame:
        return light.select(F.col("rep").alias(key), *[F.col(c).alias(prefix + c) for c in ("n", *SIGNS)])

    members = classes.select("rep", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.min("rep").alias("center"), F.count("*").alias("size")).filter("size > 1")
    shared = members.join(buckets.select("bucket", "center"), "bucket")
    shared = stage(packed(shared, total, 30_000), "buckets")

    star = shared.filter("rep <> center").select(F.col("rep").alias("a"), F.col("center").alias("b")).distinct()
    star = star.join(named("a_", "a"), "a").join(named("b_", "b"), "b").filter(_similar("a_", "b_")).select("a", "b")
    links = _verified(packed(star, total, 100_000), classes, docs)
    labels = components(links)

    # Buckets that hold several components still: rows outside the largest one meet the others.
    tagged = (
        shared.select("bucket", "rep").join(labels, F.col("rep") == F.col("node"), "left")
        .select("bucket", "rep", F.coalesce("component", "rep").alias("comp"))
    )
    held = tagged.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    open_ = (
        held.groupBy("bucket").agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("n", "comp")).alias("main"))
        .filter("comps > 1").select("bucket", "main")
    )
    rest = tagged.join(open_, "bucket").groupBy("main", "rep", "comp").agg(F.lit(None).cast("binary").alias("set"))
    rest = stage(packed(rest.join(light, "rep"), total), "open-rows")
    near = _in_blocks(rest, _meet(exact=False), "main long, rep long").distinct()
    near = stage(packed(rest.drop("set").join(near, ["main", "rep"]), total, 50_000), "near-rows")
    bags = _texts(near.select("rep").distinct(), classes, docs).withColumn("set", F.pandas_udf(_sets, "binary")("text")).select("rep", "set")
    more = stage(_in_blocks(near.join(bags, "rep"), _meet(exact=True), "a long, b long"), "across-links")
    labels = components(links.union(more))

    comp = F.coalesce("component", "rep").alias("comp")
    placed = sets.join(labels, F.col("rep") == F.col("node"), "left").select("digest", F.col("n").alias("copies"), "best", comp)
    placed = stage(packed(placed, total, 100_000), "placed")
    groups = placed.groupBy("comp").agg(F.min("best").alias("best"), F.count("*").alias("n"))
    named_sets = looked_up(placed.drop("best"), stage(packed(groups, total, 100_000), "groups"), "comp", total).select(
        "digest", F.col("copies").alias("n"), F.col("best.doc_id").alias("component_id"), F.col("best.row").alias("winner")
    )
    named_sets = stage(packed(named_sets, total, 100_000), "named-sets")
    own = rows.select("doc_id", "k1", "k2", "row", "n_shingles", "digest")
    whole = looked_up(own.filter("n_shingles > 0"), named_sets, "digest", total).withColumn("first", F.col("row") == F.col("winner"))
    alone = own.filter("n_shingles = 0").withColumns({"component_id": F.col("doc_id"), "first": F.lit(True)})
    out = ("doc_id", "k1", "k2", "row", "n_shingles", "component_id", "first")
    return whole.select(*out).union(alone.select(*out))


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, all columns; rows without words all stay."""
    first = find(docs.filter(_has_words())).filter("first").select(F.col("k1").alias("_nd_k1"), F.col("k2").alias("_nd_k2"))
    name, text = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), blob("text")
    keyed = docs.filter(_has_words()).withColumns({"_nd_k1": F.xxhash64(name, text), "_nd_k2": F.xxhash64(text, F.lit(5))})
    # Repeated rows share both hashes; one of them stays.
    kept = keyed.join(first.distinct(), ["_nd_k1", "_nd_k2"]).dropDuplicates(["_nd_k1", "_nd_k2"])
    return kept.select(*docs.columns).union(docs.filter(~_has_words()).select(*docs.columns))


def _has_words() -> Column:
    return F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
