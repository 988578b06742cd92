"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source gets a target number of words (:func:`source_lines`). Its rows are dealt into
blocks by a hash of their content; block sizes are counted by Spark. A source first
gives whole rounds of all its blocks, then a remainder: blocks in hash order, each taken if
it still fits what is left of the target. That fixes an exact quota of blocks per source. The quotas are
split among the output shards by a binary tree: at each node a multivariate
hypergeometric draw says how many blocks of each source go to the left half. A shard
then takes the next blocks of each source's permuted list, so shards are disjoint,
and its rows are ordered by a hash within the shard.

The tree first splits bundles of sources (at most ``BUNDLES``, in the driver), then each bundle's
share among its sources, in tasks; two draws one after the other are distributed as one. The
driver sees no line per source, and a table may have any number of them.

A target can be missed by about the smallest block left out, so blocks are many
(``BLOCKS`` per source, or one per row in small sources). No row is taken more than
twice as often as once, as targets stop at twice their source's size. All draws are
seeded: reruns agree. Copies that agree in source, id and text stay in one block as long as they
are no more than a block's usual rows; more of them are numbered and dealt out one by one.

Defined results: a null text has size 0; a null source is a source of its own, after all
others; rows of size 0 follow their block; a source without words has target 0, and a
table without words takes no row of any source. Which of several equal copies is taken is
not defined, how many are is. Other columns pass through, whatever
their names are, except that names that begin with ``_mix_`` are ours.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegrain.llm.common import stage
from tonegrain.operators.ranking import row_number_in_group

BLOCKS = 4096
# Sources are drawn for in this many bundles.
BUNDLES = 1024
# Lookup tables up to this many lines are broadcast, longer ones in part.
NARROW = 10_000
# Fixed value: numpy draws from fewer than this many blocks.
DRAWABLE = 1_000_000_000
SHARDS = 64
SEED = 17
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0


def size_of(text: str | Column = "text") -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null gives 0."""
    text = F.col(text) if isinstance(text, str) else text
    spaces = "[\\x20\\x09-\\x0D]+"
    inner = F.regexp_replace(text, f"^{spaces}|{spaces}$", "")
    n = F.size(F.split(inner, spaces))
    return F.when(F.length(inner) > 0, n).otherwise(0).cast("long")


def source_lines(
    sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """A staged line per source with its rank and its target, from ``source, words, rows``.

    Sources are ranked by code point, null last. Together the targets are ``share`` times all
    words, by weight; no source gives more than ``most`` times its size, and what it can't give
    is shared again by weight among the others. Each round of that is one aggregate.
    """
    ranked = row_number_in_group(
        sources.select(
            F.lit(0).alias("_mix_all"), F.col("source").isNull().alias("_mix_null"), F.col("source").alias("_mix_name"),
            F.col("words").alias("_mix_source_size"), F.col("rows").alias("_mix_rows"),
        ),
        "_mix_all", ["_mix_null", "_mix_name"], "_mix_rank",
    ).withColumn("_mix_rank", F.col("_mix_rank").cast("long") - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_mix_rank") % len(weights) + 1).cast("int"))
    lines = stage(ranked.select("_mix_rank", "_mix_name", "_mix_source_size", "_mix_rows", weight.alias("_mix_weight")), "mix-sources")
    cap = F.col("_mix_source_size") * F.lit(float(most))
    whole = lines.agg(F.sum("_mix_source_size").alias("words"), F.sum("_mix_weight").alias("free")).first()
    total = share * float(whole["words"] or 0)
    left, free, full = total, whole["free"] or 0.0, 0
    while free:
        part = F.lit(left) * F.col("_mix_weight") / F.lit(free)
        now = lines.agg(
            F.count_if(part > cap).alias("full"),
            F.sum(F.when(part > cap, cap).otherwise(0.0)).alias("given"),
            F.sum(F.when(part > cap, 0.0).otherwise(F.col("_mix_weight"))).alias("free"),
        ).first()
        if now["full"] <= full:
            break
        left, free, full = total - now["given"], now["free"], now["full"]
    target = F.least(F.lit(left) * F.col("_mix_weight") / F.lit(free), cap) if free else cap
    return lines.withColumn("_mix_target", target).drop("_mix_weight")


def _draw(rng: np.random.Generator, quota: np.ndarray, take: int) -> np.ndarray:
    """``take`` of the blocks, drawn without replacement; blocks per source.

    Of ``DRAWABLE`` blocks or more, sources give their exact shares rounded down, and only the rest is drawn.
    """
    total = int(quota.sum())
    if total < DRAWABLE:
        return rng.multivariate_hypergeometric(quota, take, method="marginals") if total else quota
    exact = [divmod(int(q) * take, total) for q in quota]
    base = np.array([whole for whole, _ in exact], np.int64)
    open_to = np.array([rest > 0 for _, rest in exact], np.int64)
    return base + rng.multivariate_hypergeometric(open_to, take - int(base.sum()), method="marginals")


def split_quotas(quotas: np.ndarray, shards: int, seed: int = SEED, sizes: np.ndarray | None = None) -> np.ndarray:
    """Blocks of each source (columns) for each shard (rows); columns add up to ``quotas``.

    A node with ``n`` shards gives its left ``n // 2`` shards a share of its blocks that is
    drawn without replacement, as if the blocks were dealt out at random. ``sizes`` fixes how
    many blocks each shard gets; otherwise shares are even.
    """
    rng = np.random.default_rng(seed)

    def go(quota: np.ndarray, first: int, n: int) -> list[np.ndarray]:
        if n == 1:
            return [quota]
        if sizes is None:
            share, odd = divmod(int(quota.sum()) * (n // 2), n)
            take = share + int(rng.random() < odd / n)
        else:
            take = int(sizes[first : first + n // 2].sum())
        left = _draw(rng, quota, take)
        return go(left, first, n // 2) + go(quota - left, first + n // 2, n - n // 2)

    return np.array(go(quotas.astype(np.int64), 0, shards))


def _lookup(df: DataFrame, lines: DataFrame, on: Column, n: int, often: Column) -> DataFrame:
    """``df`` with its line of the ``n`` lines, if any; their first column is never null.

    Up to ``NARROW`` lines are broadcast. Of more, those that ``often`` picks (at most ``NARROW``)
    are, and only rows without one of them are joined by shuffle.
    """
    if n <= NARROW:
        return df.join(F.broadcast(lines), on, "left")
    tagged = df.join(F.broadcast(lines.filter(often)), on, "left")
    mark = F.col(lines.columns[0])
    rest = tagged.filter(mark.isNull()).drop(*lines.columns).join(lines.filter(~often), on, "left")
    return tagged.filter(mark.isNotNull()).unionByName(rest)


def _bundle(seed: int, shards: int) -> callable:
    """Per bundle: its blocks in each shard, split among its sources; bounds of the shards in each source's list."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_mix_rank")
        own = [seed, int(group["_mix_bundle"].iloc[0])]
        quotas = split_quotas(group["_mix_n"].to_numpy(np.int64), shards, own, np.array(group["_mix_quota"].iloc[0], np.int64))
        return pd.DataFrame({"_mix_rank": group["_mix_rank"].to_numpy(), "_mix_bounds": np.cumsum(quotas, axis=0).T.tolist()})

    return run


def _pick(group: pd.DataFrame) -> pd.DataFrame:
    """Per source: how often each block is taken, and its place in the permuted list."""
    group = group.sort_values(["_mix_order", "_mix_block"], kind="stable")
    size = int(group["_mix_words"].sum())
    target = float(group["_mix_target"].iloc[0])
    rounds = int(target // size) if size else 0
    left = target - rounds * size
    extra = np.zeros(len(group), np.int64)
    if size:
        for i, words in enumerate(group["_mix_words"].tolist()):
            if 0 < words <= left:
                extra[i] = 1
                left -= words
        # The block that comes nearest to closing the gap, if that brings the sum nearer.
        rest = np.flatnonzero(extra == 0)
        if rest.size and left > 0:
            gap = np.abs(group["_mix_words"].to_numpy()[rest] - left)
            if gap.min() < left:
                extra[rest[gap.argmin()]] = 1
    take = extra + rounds
    return pd.DataFrame(
        {"_mix_rank": group["_mix_rank"], "_mix_block": group["_mix_block"], "_mix_take": take,
         "_mix_last": np.cumsum(take)}
    )


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> tuple[DataFrame, DataFrame]:
    """``docs`` with size, source size, target and times taken; and the table of blocks.

    Adds ``_mix_size, _mix_source_size, _mix_target, _mix_take, _mix_last``; ``_mix_last`` is the
    number of block copies of the source up to and with this block. Which copies go to which
    shard follows from :func:`split_quotas`, see :func:`mix`.
    """
    sized = docs.withColumns(
        {"_mix_size": size_of(), "_mix_key": F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))}
    )
    # A line per different row: its copies and their size.
    alike = sized.groupBy("source", "_mix_key").agg(F.count("*").alias("_mix_n"), F.max("_mix_size").alias("_mix_size"))
    keys = stage(alike, "mix-keys")
    lines = source_lines(
        keys.groupBy("source").agg(F.sum(F.col("_mix_size") * F.col("_mix_n")).alias("words"), F.sum("_mix_n").alias("rows")),
        weights, share, most,
    )
    known = lines.agg(F.count("*").alias("n"), F.sum("_mix_rows").alias("rows")).first()
    same = F.col("source").eqNullSafe(F.col("_mix_name"))

    def with_source(df: DataFrame) -> DataFrame:
        return _lookup(df, lines, same, known["n"], F.col("_mix_rows") * NARROW >= (known["rows"] or 0)).drop("_mix_name")

    # Copies beyond a block's usual rows are dealt out, one block after the other.
    deal = F.least("_mix_rows", F.lit(BLOCKS))
    first = F.pmod(F.xxhash64(F.lit(SEED), "_mix_key"), deal)
    many = (F.col("_mix_n") > 1) & (F.col("_mix_n") * deal > F.col("_mix_rows"))
    keyed = with_source(keys)
    step = F.explode(F.sequence(F.lit(0), F.when(many, F.least("_mix_n", deal)).otherwise(1).cast("int") - 1))
    rest = F.pmod(F.col("_mix_n"), deal)
    held = F.when(many, (F.col("_mix_n") - rest) / deal + (F.col("_mix_step") < rest).cast("int")).otherwise(F.col("_mix_n")).cast("long")
    blocks = (
        keyed.withColumn("_mix_step", step)
        .withColumn("_mix_block", F.pmod(first + F.col("_mix_step"), deal))
        .groupBy("_mix_rank", "_mix_block")
        .agg(F.sum(F.col("_mix_size") * held).alias("_mix_words"), F.first("_mix_target").alias("_mix_target"))
        .withColumn("_mix_order", F.xxhash64(F.lit(SEED + 1), "_mix_rank", "_mix_block"))
    )
    picked = stage(
        blocks.groupBy("_mix_rank").applyInPandas(_pick, "_mix_rank long, _mix_block long, _mix_take long, _mix_last long"),
        "mix-blocks",
    )
    rows = with_source(sized)
    heavy = keyed.filter(many).select(
        F.lit(True).alias("_mix_heavy"), F.col("_mix_rank").alias("_mix_of"), F.col("_mix_key").alias("_mix_same"), "_mix_n"
    )
    n_heavy = heavy.count()
    if n_heavy:
        own = (F.col("_mix_rank") == F.col("_mix_of")) & (F.col("_mix_key") == F.col("_mix_same"))
        marked = _lookup(rows, heavy, own, n_heavy, F.col("_mix_n") * NARROW >= known["rows"]).drop("_mix_of", "_mix_same", "_mix_n")
        copies = marked.filter("_mix_heavy").select(
            F.struct("*").alias("_mix_all"), F.xxhash64("_mix_rank", "_mix_key").alias("_mix_group"),
            F.monotonically_increasing_id().alias("_mix_id"),
        )
        numbered = row_number_in_group(copies, "_mix_group", ["_mix_id"], "_mix_no").select("_mix_all.*", F.col("_mix_no") - 1)
        rows = (
            marked.filter(F.col("_mix_heavy").isNull()).withColumn("_mix_no", F.lit(0))
            .union(numbered).withColumn("_mix_block", F.pmod(first + F.col("_mix_no"), deal)).drop("_mix_heavy", "_mix_no")
        )
    else:
        rows = rows.withColumn("_mix_block", first)
    return rows.join(picked, ["_mix_rank", "_mix_block"]).drop("_mix_rows"), picked


def place(planned: DataFrame, picked: DataFrame, shards: int = SHARDS) -> DataFrame:
    """A line for every copy of a row in the mix, with its ``_mix_shard`` and its ``_mix_place`` in the source's list.

    ``planned`` and ``picked`` are those of :func:`plan`.
    """
    ends = (
        picked.groupBy("_mix_rank").agg(F.max("_mix_last").alias("_mix_n"))
        .withColumn("_mix_bundle", F.pmod("_mix_rank", F.lit(BUNDLES)))
    )
    sums = ends.groupBy("_mix_bundle").agg(F.sum("_mix_n").alias("n")).orderBy("_mix_bundle").collect()  # at most BUNDLES lines
    quotas = split_quotas(np.array([r["n"] for r in sums], np.int64), shards) if sums else np.zeros((shards, 0), int)
    shares = picked.sparkSession.createDataFrame(
        [(r["_mix_bundle"], quotas[:, i].tolist()) for i, r in enumerate(sums)], "_mix_bundle long, _mix_quota array<long>"
    )
    bounds = (
        ends.join(F.broadcast(shares), "_mix_bundle").groupBy("_mix_bundle")
        .applyInPandas(_bundle(SEED, shards), "_mix_rank long, _mix_bounds array<long>")
    )
    # Copy number c of a block stands at place _mix_last - c of its source's permuted list.
    places = F.sequence(F.col("_mix_last") - F.col("_mix_take"), F.col("_mix_last") - 1)
    shard = F.size(F.filter("_mix_bounds", lambda b: b <= F.col("_mix_place")))
    dealt = (
        picked.filter("_mix_take > 0").join(bounds, "_mix_rank").withColumn("_mix_place", F.explode(places))
        .select("_mix_rank", "_mix_block", "_mix_place", shard.alias("_mix_shard"))
    )
    return planned.join(stage(dealt, "mix-shards"), ["_mix_rank", "_mix_block"])


def taken(docs: DataFrame, shards: int = SHARDS, **how) -> DataFrame:
    """``doc_id`` and the columns of :func:`plan` for every row, with ``_mix_copies``: in how many places of the shards it stands."""
    planned, picked = plan(docs, **how)
    own = [c for c in planned.columns if c.startswith("_mix_")]
    rows = stage(planned.select("doc_id", *own).withColumn("_mix_row", F.monotonically_increasing_id()), "mix-plan")
    # Places beyond the last shard's bound would be in no shard.
    placed = place(rows, picked, shards).filter(F.col("_mix_shard") < shards)
    copies = placed.groupBy("_mix_row").agg(F.count("*").alias("_mix_copies"))
    return rows.join(copies, "_mix_row", "left").withColumn("_mix_copies", F.coalesce("_mix_copies", F.lit(0)))


def mix(docs: DataFrame, shards: int = SHARDS, **how) -> DataFrame:
    """The rows of the mix with all columns of ``docs``, repeats included, by shard.

    Rows are laid out by shard and ordered by a seeded hash inside it.
    """
    order = F.xxhash64(F.lit(SEED + 2), "_mix_key", "_mix_place")
    return (
        place(*plan(docs, **how), shards).withColumn("_mix_order", order)
        .repartition(shards, "_mix_shard")
        .sortWithinPartitions("_mix_shard", "_mix_order")
        .select(*docs.columns)
    )
