"""Near-duplicate vectors: robust-pruned flat graphs, range-expanding greedy search, verified links.

Vectors are compared only inside a label (and a dimension) by cosine in double precision.
Equal vectors are one class. The classes of a label are clustered until a shard holds at
most ``SHARD`` of them; every class goes to its nearest centre, its home, and to the
``OVERLAP - 1`` next ones; centres as near as each other share rows by hash, and a part that a split
hardly made smaller is dealt out by hash, each of its rows to be compared to all of it. Centres are at most ``CENTRES`` rows per split, those of smallest hash.

1. Each shard builds a flat graph: a row's nearest rows and some far ones are pruned to
   ``DEGREE`` neighbours by the robust rule (a neighbour is dropped if one already taken is
   ``ALPHA`` times closer to it than the row is). Rows that are the same but for rounding are linked in rings.
2. The adjacency lists a row got in its shards are united.
3. In its home shard every row searches greedily from the medoids with a beam of ``BEAM``, then
   expands: the neighbours of every row found in range, or nearly, are visited until none is new.
4. A row visits every other shard that is the home of a row it found in range, or nearly, there or among
   its nearest rows in any of its shards, and is compared to all rows of that shard, ``VISITORS`` rows to a
   task; what it finds there leads it on, until no shard is new. Both ends of a link go to each other's home.
5. What is found is verified in double precision. A link is counted in the home shard of the partner,
   so once, however many shards a group fills; links form components.

Every row is indexed and is a query. :func:`audit` counts the links of the rows whose id is divisible by ``EVERY``
against all rows, in blocks, and gives the share of them that was found. Below ``FLOOR`` every row is compared to
all shards of its label and dimension instead (:func:`everywhere`), which finds all links.

Defined results: null vectors, vectors without components or of length zero, vectors that hold
null or non-finite components and rows without a label link with nothing; repeated rows link with
each other; a null id counts as larger than any other; other columns are ignored whatever their
names are; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonegrain.llm.common import mix64, stage
from tonegrain.llm.graph import components

LINK = 0.98
SHARD, OVERLAP, CENTRES = 3000, 2, 64
DEGREE, POOL, FAR, ALPHA = 24, 48, 8, 1.2
BEAM, ENTRIES, SLACK = 32, 8, 0.04
CHUNK = 512
VISITORS = 1024
#: Rows this close are the same but for rounding.
TIGHT = 1e-6
#: A part of a split that keeps more than this share of the rows is dealt out by hash.
STUCK = 0.9
FOUND = "rep long, group long, n long, to array<long>"
#: Rows with an id divisible by this are counted by brute force.
EVERY = 20
#: With a smaller share of links found, every row is compared to all others of its label.
FLOOR = 0.9


def _unit(vectors: pd.Series) -> np.ndarray:
    """Rows scaled to length one, in double precision."""
    x = np.array(vectors.tolist(), np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def classes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows with their class (null if they can't link), and the classes with a vector each."""
    e = F.col("embedding")
    odd = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(e, lambda x: x != 0)
    rows = stage(
        vectors.select(F.col("vec_id").cast("long"), "label", F.col("embedding").cast("array<double>"))
        .withColumns({"row": F.monotonically_increasing_id(), "usable": F.coalesce(F.col("label").isNotNull() & ~odd & some, F.lit(False))})
        .withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(3), "embedding"), "dim": F.size("embedding")}),
        "vectors",
    )
    key = ["label", "dim", "h1", "h2"]
    reps = rows.filter("usable").groupBy(key).agg(F.min("row").alias("rep"), F.count("*").alias("copies"))
    reps = stage(reps, "vector-classes")
    placed = rows.drop("embedding").join(
        reps.select(*key, "rep", "copies").withColumn("usable", F.lit(True)), ["usable", *key], "left"
    )
    vector = rows.select(F.col("row").alias("rep"), "embedding")
    return placed, stage(reps.drop("h1", "h2").join(vector, "rep"), "class-vectors")


def _nearest(count: int) -> callable:
    def run(rows: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        names = ["cluster", "rep", "part", "home", "was"]
        if rows.empty or centres.empty:
            return pd.DataFrame({c: [] for c in names})
        centres = centres.sort_values("part")
        cos = np.round(_unit(rows["embedding"]) @ _unit(centres["centre"]).T, 6)
        k = min(count, len(centres))
        # Rows as near to many centres are dealt out among them by row and centre.
        with np.errstate(over="ignore"):
            tie = mix64(rows["rep"].to_numpy().astype(np.uint64)[:, None] * np.uint64(31) + centres["part"].to_numpy().astype(np.uint64))
        best = np.lexsort((tie, -cos), axis=1)[:, :k]
        return pd.DataFrame({
            "cluster": rows["cluster"].repeat(k).to_numpy(),
            "rep": rows["rep"].repeat(k).to_numpy(),
            "part": centres["part"].to_numpy()[best].ravel(),
            "home": (rows["home"].to_numpy()[:, None] & (np.arange(k) == 0)).ravel(),
            "was": rows["size"].repeat(k).to_numpy(),
        })

    return run


def shards_of(classes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``(cluster, rep, home)``: the shards of every class, one of them its home; and visits that are due at any rate.

    A cluster that a split hardly made smaller is dealt into shards by hash; as those say nothing
    about who is near, each of its rows is due a visit (``rep, cluster``) to all of them.
    """
    seat = classes.select(F.xxhash64("label", "dim").alias("cluster"), "rep", F.lit(True).alias("home"), F.lit(None).cast("long").alias("was"))
    done = due = None
    while True:
        sizes = seat.groupBy("cluster").agg(F.count("*").alias("size"))
        seat = stage(seat.join(sizes, "cluster"), "seats")
        fits = seat.filter(F.col("size") <= SHARD).select("cluster", "rep", "home")
        done = fits if done is None else done.union(fits)
        large = seat.filter(F.col("size") > SHARD)
        if large.isEmpty():
            return done, due
        stuck = F.coalesce(F.col("size") > F.col("was") * STUCK, F.lit(False))
        deals = F.ceil(F.col("size") * 2 / SHARD)
        dealt = large.filter(stuck).withColumn("deals", deals).withColumn("deal", F.pmod(F.xxhash64(F.lit(29), "rep"), F.col("deals")))
        done = done.union(dealt.select(F.xxhash64("cluster", "deal").alias("cluster"), "rep", "home"))
        visits = (
            dealt.withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)))
            .filter(~(F.col("home") & (F.col("to") == F.col("deal"))))
            .select("rep", F.xxhash64("cluster", "to").alias("cluster"))
        )
        due = visits if due is None else due.union(visits)
        large = large.filter(~stuck)
        # About half a shard per centre, as every row is seated twice.
        parts = F.least(F.ceil(F.col("size") * 2 * OVERLAP / SHARD), F.lit(CENTRES))
        order = Window.partitionBy("cluster").orderBy(F.xxhash64(F.lit(11), "cluster", "rep"), "rep")
        picked = large.withColumn("part", F.row_number().over(order)).filter(F.col("part") <= CENTRES).filter(F.col("part") <= parts)
        vectors = classes.select("rep", "embedding")
        slices = F.ceil(F.col("size") / 4096)
        rows = large.withColumn("slice", F.pmod(F.xxhash64("rep"), slices)).join(vectors, "rep")
        centres = picked.join(vectors, "rep").select(
            F.col("cluster").alias("near"), "part", F.col("embedding").alias("centre"),
            F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)).alias("at"),
        )
        moved = (
            rows.select("cluster", "slice", "rep", "home", "size", "embedding").groupBy("cluster", "slice")
            .cogroup(centres.groupBy("near", "at"))
            .applyInPandas(_nearest(OVERLAP), "cluster long, rep long, part long, home boolean, was long")
        )
        # A class may come to a part by two ways; it keeps its home there.
        seat = (
            moved.select(F.xxhash64("cluster", "part").alias("cluster"), "rep", "home", "was")
            .groupBy("cluster", "rep").agg(F.bool_or("home").alias("home"), F.max("was").alias("was"))
        )


def robust_prune(x: np.ndarray, own: np.ndarray, pool: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[np.ndarray]:
    """Neighbours (row numbers of ``x``) for the rows ``own``, out of their lines of ``pool``."""
    cos = np.einsum("nd,npd->np", x[own], x[pool])
    order = np.argsort(-cos, axis=1, kind="stable")
    pool, away = np.take_along_axis(pool, order, 1), 1 - np.take_along_axis(cos, order, 1)
    alive = pool != own[:, None]
    taken, lines = np.zeros_like(alive), np.arange(len(own))
    for _ in range(degree):
        if not alive.any():
            break
        first, left = alive.argmax(axis=1), alive.any(axis=1)
        taken[lines[left], first[left]] = True
        between = 1 - np.einsum("nd,npd->np", x[pool[lines, first]], x[pool])
        alive[lines, first] = False
        alive &= alpha * between > away
    return [np.unique(p[t]) for p, t in zip(pool, taken, strict=True)]


def tight_links(x: np.ndarray, tight: np.ndarray) -> dict[int, np.ndarray]:
    """Links between rows of ``tight`` that are the same but for rounding, which the robust rule would thin out to nothing.

    Rows within ``TIGHT`` of a leader, in a ring, are linked to those 1, 2, 4, ... places on and back.
    """
    out: dict[int, np.ndarray] = {}
    while tight.size:
        near = x[tight] @ x[tight[0]] >= 1 - TIGHT
        near[0] = True
        ring, tight = tight[near], tight[~near]
        steps = 1 << np.arange(max(0, (ring.size - 1).bit_length()))
        for i, row in enumerate(ring.tolist()):
            out[row] = ring[np.concatenate([i + steps, i - steps]) % ring.size]
    return out


def _build(group: pd.DataFrame) -> pd.DataFrame:
    """Adjacency lists of a shard, and the homes, other than their own, of the rows close to each row."""
    group = group.sort_values("rep")
    rep, at, x = group["rep"].to_numpy(), group["at"].to_numpy(), _unit(group["embedding"]).astype(np.float32)
    n, k, lists, to, tight = len(rep), min(POOL, len(rep)), [], [], []
    rng = np.random.default_rng(n)
    for lo in range(0, n, CHUNK):
        own = np.arange(lo, min(lo + CHUNK, n))
        cos = x[own] @ x.T
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        closeness = np.take_along_axis(cos, near, 1)
        close = closeness >= LINK - SLACK
        tight.append(own[(closeness >= 1 - TIGHT).sum(axis=1) > 1])
        to += [np.setdiff1d(at[p[c]], at[i]).tolist() for i, p, c in zip(own, near, close, strict=True)]
        pool = np.concatenate([near, rng.integers(0, n, (len(own), FAR))], axis=1)
        lists += robust_prune(x, own, pool)
    more = tight_links(x, np.concatenate(tight))
    near = [rep[np.union1d(p, more[i]) if i in more else p].tolist() for i, p in enumerate(lists)]
    return pd.DataFrame({"rep": rep, "near": near, "to": to})


def greedy_range(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Cosines of the rows each query visited; others are -2. ``graph`` has -1 for no neighbour."""
    q = x[queries]
    seen = np.full((len(queries), len(x)), -2.0, np.float32)
    seen[:, entries] = q @ x[entries].T
    beam = np.tile(entries, (len(queries), 1))
    score = seen[:, entries].copy()
    fresh = np.ones(beam.shape, bool)
    lines = np.arange(len(queries))

    def visit(line: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Visit the neighbours of pairs; the new pairs."""
        to = graph[node]
        line, to = np.repeat(line, to.shape[1]), to.ravel()
        new = (to >= 0) & (seen[line, to] < -1.5)
        pair = np.unique(line[new] * len(x) + to[new])
        line, to = np.divmod(pair, len(x))
        seen[line, to] = np.einsum("nd,nd->n", q[line], x[to])
        return line, to

    while True:
        open_ = np.where(fresh, score, -3.0)
        best = open_.argmax(axis=1)
        go = open_[lines, best] > -2.5
        if not go.any():
            break
        fresh[lines, best] = False
        line, to = visit(lines[go], beam[lines[go], best[go]])
        if not line.size:
            continue
        # New rows join the beams, which keep their BEAM best.
        counts = np.bincount(line, minlength=len(queries))
        slot = np.arange(line.size) - np.repeat(np.cumsum(counts) - counts, counts)
        add = np.full((len(queries), counts.max()), -1)
        add_score = np.full(add.shape, -3.0, np.float32)
        add[line, slot], add_score[line, slot] = to, seen[line, to]
        beam, score = np.concatenate([beam, add], axis=1), np.concatenate([score, add_score], axis=1)
        fresh = np.concatenate([fresh, add >= 0], axis=1)
        keep = np.argsort(-score, axis=1, kind="stable")[:, :BEAM]
        beam, score, fresh = (np.take_along_axis(a, keep, 1) for a in (beam, score, fresh))
    line, node = np.nonzero(seen >= LINK - SLACK)
    while line.size:
        line, node = visit(line, node)
        near = seen[line, node] >= LINK - SLACK
        line, node = line[near], node[near]
    return seen


def _homes(to: list[set], rows: np.ndarray, at: np.ndarray) -> None:
    """Add to the sets of ``rows`` the shards ``at``, pair by pair."""
    pairs = pd.DataFrame({"row": rows, "at": at}).drop_duplicates()
    for i, shard in zip(pairs["row"].tolist(), pairs["at"].tolist(), strict=True):
        to[i].add(shard)


def _search(group: pd.DataFrame) -> pd.DataFrame:
    """For rows of a shard: the smallest row linked to it here, where it goes next and, if at home here, how many rows at home here it links with."""
    group = group.sort_values("rep")
    rep, copies, unit = group["rep"].to_numpy(), group["copies"].to_numpy(), _unit(group["embedding"])
    here, at = int(group["cluster"].iloc[0]), group["at"].to_numpy()
    inside = at == here
    x, n = unit.astype(np.float32), len(rep)
    known = {r: i for i, r in enumerate(rep.tolist())}
    near = [[known[r] for r in line if r in known] for line in group["near"]]
    graph = np.full((n, max([1, *map(len, near)])), -1)
    for i, line in enumerate(near):
        graph[i, : len(line)] = line
    # Medoids: of the shard, and of slices of it.
    parts = [np.arange(n), *np.array_split(np.arange(n), min(ENTRIES - 1, n))]
    entries = np.unique([p[np.argmax(x[p] @ x[p].mean(axis=0))] for p in parts])
    home = np.flatnonzero(inside)
    label, found, total = np.arange(n), [], np.zeros(n, np.int64)
    to = [set(t) if h else set() for t, h in zip(group["to"], inside, strict=True)]
    for lo in range(0, len(home), CHUNK):
        own = home[lo : lo + CHUNK]
        seen = greedy_range(x, graph, own, entries)
        line, node = np.nonzero((seen >= LINK - SLACK) & ~inside)
        _homes(to, own[line], at[node])
        line, node = np.nonzero(seen >= LINK - 1e-3)
        a = own[line]
        true = (a != node) & (np.einsum("nd,nd->n", unit[a], unit[node]) >= LINK)
        a, node = a[true], node[true]
        np.add.at(total, a, copies[node] * inside[node])
        found.append((a, node))
    a, b = (np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in (0, 1))
    for i in np.unique(b[~inside[b]]):
        to[i].add(here)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            break
    ends = np.unique(np.concatenate([a, b, home]))
    return pd.DataFrame({
        "rep": rep[ends], "group": rep[label[ends]], "n": np.where(inside[ends], total[ends], -1), "to": [sorted(to[i]) for i in ends],
    })


def _visit(guests: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """As :func:`_search`, for guests from other homes, compared to all rows of a shard."""
    if guests.empty or rows.empty:
        return pd.DataFrame({c.split()[0]: [] for c in FOUND.split(", ")})
    guests, rows = guests.sort_values("rep"), rows.sort_values("rep")
    here, at, from_ = int(rows["cluster"].iloc[0]), rows["at"].to_numpy(), guests["at"].to_numpy()
    a, b, inside = guests["rep"].to_numpy(), rows["rep"].to_numpy(), at == here
    cos = _unit(guests["embedding"]) @ _unit(rows["embedding"]).T
    hit = (cos >= LINK) & (a[:, None] != b)
    total = hit[:, inside] @ rows["copies"].to_numpy()[inside]
    to: list[set] = [set() for _ in range(len(a) + len(b))]
    line, node = np.nonzero((cos >= LINK - SLACK) & (at != here) & (at != from_[:, None]))
    _homes(to, line, at[node])
    line, node = np.nonzero(hit & inside)
    _homes(to, node + len(a), from_[line])
    most = np.iinfo(np.int64).max
    left, right = a.copy(), b.copy()
    while True:
        before = left, right
        left = np.minimum(left, np.where(hit, right, most).min(axis=1))
        right = np.minimum(right, np.where(hit, left[:, None], most).min(axis=0))
        if (left == before[0]).all() and (right == before[1]).all():
            break
    ends = np.flatnonzero(np.concatenate([np.ones(len(a), bool), hit.any(axis=0)]))
    return pd.DataFrame({
        "rep": np.concatenate([a, b])[ends], "group": np.concatenate([left, right])[ends],
        "n": np.concatenate([total, np.full(len(b), -1)])[ends], "to": [sorted(to[i]) for i in ends],
    })


def _visits(front: DataFrame, full: DataFrame, classes: DataFrame, homes: DataFrame) -> DataFrame:
    """What the classes of ``front(rep, cluster)`` find in these shards; a shard is repeated for every ``VISITORS`` guests."""
    blocks = front.groupBy("cluster").agg(F.ceil(F.count("*") / VISITORS).alias("blocks"))
    guests = (
        front.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
        .join(classes.select("rep", "embedding"), "rep").join(homes, "rep").select("cluster", "block", "rep", "at", "embedding")
    )
    rows = full.join(blocks, "cluster").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("cluster", "block", "rep", "at", "copies", "embedding")
    return guests.groupBy("cluster", "block").cogroup(rows.groupBy("cluster", "block")).applyInPandas(_visit, FOUND)


def _count(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    if asked.empty or rows.empty:
        return pd.DataFrame({"rep": [], "n": []})
    hit = _unit(asked["embedding"]) @ _unit(rows["embedding"]).T >= LINK
    hit &= asked["rep"].to_numpy()[:, None] != rows["rep"].to_numpy()
    return pd.DataFrame({"rep": asked["rep"], "n": hit @ rows["copies"].to_numpy()})


def audit(placed: DataFrame, classes: DataFrame, counted: DataFrame, every: int = EVERY) -> tuple[float, int]:
    """Found share and number of the links that the rows with an id divisible by ``every`` have with other vectors.

    The number comes from all rows, in blocks of some ``VISITORS`` asked classes by ``SHARD`` classes, so a label of any
    size spreads over tasks. Without a link the share is 1.
    """
    ids = stage(placed.filter(F.col("usable") & (F.col("vec_id") % every == 0)).groupBy("rep").agg(F.count("*").alias("rows")), "asked")
    asked = classes.join(ids.select("rep"), "rep")
    key = ["label", "dim"]
    blocks = (
        asked.groupBy(key).agg(F.ceil(F.count("*") / VISITORS).alias("blocks"))
        .join(classes.groupBy(key).agg(F.ceil(F.count("*") / SHARD).alias("parts")), key)
    )

    def dealt(own: str, other: str, rows: DataFrame) -> DataFrame:
        """Rows with a block of their own kind, repeated for each of the other."""
        numbered = rows.join(blocks, key)
        return numbered.withColumn(own, F.pmod(F.xxhash64(F.lit(31), "rep"), F.col(own + "s"))).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other + "s") - 1))
        ).select(*key, "block", "part", "rep", "copies", "embedding")

    by = [*key, "block", "part"]
    names = [*by, "rep", "copies", "embedding"]
    # Renamed, as both sides come from the same table.
    pairs = dealt("block", "part", asked).toDF(*names).groupBy(by).cogroup(dealt("part", "block", classes).groupBy(by))
    true = pairs.applyInPandas(_count, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))
    both = ids.join(true, "rep").join(counted.select("rep", F.col("n").alias("found")), "rep", "left")
    found = F.least("n", F.coalesce("found", F.lit(0)))
    line = both.agg(F.sum(F.col("n") * F.col("rows")).alias("n"), F.sum(found * F.col("rows")).alias("found")).first()
    return (line["found"] / line["n"], line["n"]) if line["n"] else (1.0, 0)


def everywhere(full: DataFrame, classes: DataFrame, homes: DataFrame) -> DataFrame:
    """What every class finds in all shards of its label and dimension: all links."""
    at = homes.join(classes.select("rep", "label", "dim"), "rep").select("label", "dim", F.col("at").alias("cluster")).distinct()
    return _visits(classes.select("rep", "label", "dim").join(at, ["label", "dim"]).select("rep", "cluster"), full, classes, homes)


def _counted(searched: DataFrame) -> DataFrame:
    return stage(searched.filter("n >= 0").groupBy("rep").agg(F.sum("n").alias("n")), "counted-links")


def find(vectors: DataFrame) -> DataFrame:
    """``vec_id, n_links, component_id, first, audit_recall, audit_links`` for every row of ``vectors(vec_id, embedding, label)``.

    ``first`` marks one row of each component, one with its smallest id. The last two are the figures of :func:`audit`.
    """
    placed, classes = classes_of(vectors)
    seats, due = shards_of(classes)
    homes = seats.filter("home").select("rep", F.col("cluster").alias("at"))
    full = stage(
        seats.select("cluster", "rep").join(homes, "rep").join(classes.select("rep", "copies", "embedding"), "rep"), "shards"
    )
    lists = full.groupBy("cluster").applyInPandas(_build, "rep long, near array<long>, to array<long>")
    lists = lists.groupBy("rep").agg(
        *[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("near", "to")]
    )
    found = stage(full.join(lists, "rep").groupBy("cluster").applyInPandas(_search, FOUND), "found")
    searched, done = found, None
    while True:
        # Every class goes to a shard once.
        front = found.select("rep", F.explode("to").alias("cluster"))
        front = (front if due is None else front.union(due)).distinct()
        due = None
        front = stage(front if done is None else front.join(done, ["rep", "cluster"], "left_anti"), "visits")
        if front.isEmpty():
            break
        done = front if done is None else done.union(front)
        found = stage(_visits(front, full, classes, homes), "found")
        searched = searched.union(found)
    counted = _counted(searched)
    recall, links = audit(placed, classes, counted)
    if recall < FLOOR:
        searched = stage(everywhere(full, classes, homes), "found")
        counted = _counted(searched)
        recall, links = audit(placed, classes, counted)
    labels = components(searched.select(F.col("rep").alias("a"), F.col("group").alias("b")).filter("a <> b"))
    comp = F.coalesce("component", "rep", "row")
    rows = stage(
        placed.join(counted, "rep", "left").join(labels, F.col("rep") == F.col("node"), "left").select(
            "vec_id", "row", comp.alias("comp"), F.coalesce(F.col("n") + F.col("copies") - 1, F.lit(0)).alias("n_links")
        ),
        "placed-vectors",
    )
    ids = rows.groupBy("comp").agg(F.min("vec_id").alias("component_id"))
    rows = rows.join(ids, "comp")
    winners = rows.filter(F.col("vec_id").eqNullSafe(F.col("component_id"))).groupBy("comp").agg(F.min("row").alias("winner"))
    return rows.join(winners, "comp").select(
        "vec_id", "n_links", "component_id", (F.col("row") == F.col("winner")).alias("first"),
        F.lit(recall).alias("audit_recall"), F.lit(links).cast("long").alias("audit_links"),
    )
