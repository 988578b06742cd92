"""K-means in whole numbers, distances by bit planes and popcounts.

A component becomes ``floor(64 * x)``. Bit ``i`` of all 64 components of a vector is one 64-bit plane; numbers are in two's
complement, so the top plane weighs ``-2**i``, any other ``2**i``. The dot product of two vectors is the sum, over pairs
of planes, of the product of their weights times the number of bits that both planes hold: exact, whatever the
order. A batch uses as many planes as its largest component needs, each round's centroids likewise.

The packed vectors are written once and read in every round. A task sends one line per cluster (count and component sums);
Spark adds them up, and 16 centroids reach the driver. No row is shuffled.

Defined results: vectors that are null, not of 64 components, or hold null or non-finite components give no row. A
missing id is hashed as an empty text; rows of one id rank among themselves by components. With fewer than
``CLUSTERS`` vectors there are as many centroids; equal centroids keep their numbers, the first wins. Components are held to
``+-LARGEST`` (a distance then fits 64 bits), inertia to the largest 64-bit number. Other columns are ignored
whatever their names are; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegrain.llm.common import stage

DIMS = 64
CLUSTERS, ROUNDS = 16, 3
LARGEST = 1 << 27
MOST = (1 << 63) - 1
#: Vectors whose distances are found at once.
CHUNK = 8192


def planes_of(numbers: np.ndarray) -> np.ndarray:
    """Whole numbers (rows of 64) as bit planes (rows of uint64), no more than they need."""
    bits = 1 + int(max(int(numbers.max(initial=0)).bit_length(), int(~numbers.min(initial=-1)).bit_length()))
    places = np.left_shift(np.uint64(1), np.arange(DIMS, dtype=np.uint64))
    return np.stack([np.where((numbers >> i) & 1, places, np.uint64(0)).sum(axis=1, dtype=np.uint64) for i in range(bits)], axis=1)


def numbers_of(planes: np.ndarray) -> np.ndarray:
    """The numbers that planes hold."""
    out = np.zeros((len(planes), DIMS), np.int64)
    for i, weight in enumerate(weights(planes.shape[1])):
        held = np.unpackbits(np.ascontiguousarray(planes[:, i]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out += held.astype(np.int64) * weight
    return out


def weights(bits: int) -> list[int]:
    return [1 << i for i in range(bits - 1)] + [-(1 << (bits - 1))]


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of every row of ``a`` with every row of ``b``, both in planes."""
    out = np.zeros((len(a), len(b)), np.int64)
    for i, wi in enumerate(weights(a.shape[1])):
        for j, wj in enumerate(weights(b.shape[1])):
            out += np.bitwise_count(a[:, i, None] & b[None, :, j]).astype(np.int64) * (wi * wj)
    return out


def norms(a: np.ndarray) -> np.ndarray:
    """Squared lengths of vectors in planes."""
    out = np.zeros(len(a), np.int64)
    for i, wi in enumerate(weights(a.shape[1])):
        for j, wj in enumerate(weights(a.shape[1])):
            out += np.bitwise_count(a[:, i] & a[:, j]).astype(np.int64) * (wi * wj)
    return out


def nearest(planes: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centre; the first of equals."""
    lengths = norms(centres)
    found, away = np.empty(len(planes), np.int32), np.empty(len(planes), np.int64)
    for lo in range(0, len(planes), CHUNK):
        own = planes[lo : lo + CHUNK]
        d = norms(own)[:, None] - 2 * dots(own, centres) + lengths
        found[lo : lo + CHUNK] = best = d.argmin(axis=1)
        away[lo : lo + CHUNK] = d[np.arange(len(own)), best]
    return found, away


def _batch_planes(column: pa.Array) -> np.ndarray:
    """Planes of a column of packed vectors; those of fewer planes repeat their top one, which leaves the number as it is."""
    own = column.to_pylist()
    widths = {len(x) // 8 for x in own}
    if len(widths) > 1:
        own = [x + x[-8:] * (max(widths) - len(x) // 8) for x in own]
    return np.frombuffer(b"".join(own), np.uint64).reshape(len(own), max(widths))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMS)
        whole = np.clip(np.floor(x * 64.0), -LARGEST, LARGEST - 1).astype(np.int64)
        packed = pa.array([row.tobytes() for row in planes_of(whole)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), packed], names=["vec_id", "planes"])


def pack(vectors: DataFrame) -> DataFrame:
    """``(vec_id, planes)`` of the usable rows; written once."""
    e = F.col("embedding").cast("array<double>")
    odd = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vectors.filter(F.coalesce((F.size("embedding") == DIMS) & ~odd, F.lit(False)))
    own = usable.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"))
    return stage(own.mapInArrow(_pack, "vec_id long, planes binary"), "bit-planes")


def first_centres(packed: DataFrame, clusters: int = CLUSTERS) -> np.ndarray:
    """Numbers of the vectors whose ids have the smallest hashes, in that order."""
    order = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    ranked = packed.withColumn("order", order)
    # Rows of one id tie: all that tie with the last are looked at, each once.
    last = ranked.select("order").orderBy("order").limit(clusters).agg(F.max("order")).scalar()
    lines = (
        ranked.filter(F.col("order") <= last).groupBy("order", "planes").agg(F.count("*").alias("n"))
        .withColumn("n", F.least("n", F.lit(clusters))).mapInArrow(_unpack, "order string, n long, numbers array<long>")
        .orderBy("order", "numbers").limit(clusters).collect()
    )
    out = [r["numbers"] for r in lines for _ in range(r["n"])]
    return np.array(out[:clusters], np.int64).reshape(-1, DIMS)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            numbers = numbers_of(_batch_planes(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(numbers.tolist(), pa.list_(pa.int64()))], names=["order", "n", "numbers"]
            )


def next_centres(packed: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean of each centre's vectors; a centre without any stays."""
    shared = packed.sparkSession.sparkContext.broadcast(planes_of(centres))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, count, total = shared.value, np.zeros(len(centres), np.int64), np.zeros(centres.shape, np.int64)
        for batch in batches:
            if batch.num_rows:
                planes = _batch_planes(batch.column(0))
                cluster, numbers = nearest(planes, own)[0], numbers_of(planes)
                count += np.bincount(cluster, minlength=len(count))
                for i in np.unique(cluster):
                    total[i] += numbers[cluster == i].sum(axis=0)
        met = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(met.astype(np.int32)), pa.array(count[met]), pa.array(total[met].tolist(), pa.list_(pa.int64()))],
            names=["cluster", "n", "total"],
        )

    parts = packed.select("planes").mapInArrow(add, "cluster int, n long, total array<long>")
    sums = parts.select("cluster", "n", F.posexplode("total").alias("at", "value")).groupBy("cluster", "at").agg(
        F.sum("value").alias("value"), F.sum("n").alias("n")
    )
    out = centres.copy()
    for r in sums.collect():  # at most a line for each centre and component
        out[r["cluster"], r["at"]] = r["value"] // r["n"]
    return out


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for every usable row."""
    spark = vectors.sparkSession
    packed = pack(vectors)
    centres = first_centres(packed, clusters)
    for _ in range(rounds if len(centres) else 0):
        centres = next_centres(packed, centres)
    shared = spark.sparkContext.broadcast(planes_of(centres))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, away = nearest(_batch_planes(batch.column(1)), shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own), pa.array(away)], names=["vec_id", "cluster", "distance"])

    placed = stage(packed.mapInArrow(assign, "vec_id long, cluster int, distance long"), "clustered")
    total = F.sum(F.col("distance").cast("decimal(38,0)"))

    def held(x):
        return F.least(x, F.lit(MOST).cast("decimal(38,0)")).cast("long")

    sums = placed.groupBy("cluster").agg(total.alias("own"))
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    digest = F.element_at(F.array(*[F.lit(x) for x in names] or [F.lit("")]), F.col("cluster") + 1)
    everything = placed.agg(held(total).alias("all")).scalar()
    lines = sums.select("cluster", held(F.col("own")).alias("cluster_inertia"), everything.alias("inertia"), digest.alias("centroid_sha256"))
    return placed.join(F.broadcast(lines), "cluster").select(  # a line per cluster
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


_ASSIGN = """
    a{i} AS (SELECT id, vec_id, e, min_by(num, {{'d': d, 'num': num}}) AS cluster, min(d) AS distance FROM (
      SELECT v.id, v.vec_id, v.e, c.num, CAST(list_sum(list_transform(list_zip(v.e, c.e), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS BIGINT) AS d
      FROM v, c{i} AS c) GROUP BY ALL),"""
_MOVE = """
    m{i} AS (SELECT cluster, list(s ORDER BY pos) AS e FROM (
      SELECT cluster, pos, CAST((sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*) AS BIGINT) AS s FROM (
        SELECT cluster, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM a{i}) GROUP BY cluster, pos) GROUP BY cluster),
    c{j} AS (SELECT c.num, coalesce(m.e, c.e) AS e FROM c{i} AS c LEFT JOIN m{i} AS m ON c.num = m.cluster),"""

#: The same in DuckDB, every distance by plain subtraction.
SQL = (
    f"""
    WITH v AS (SELECT row_number() OVER () AS id, vec_id,
        list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
      WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    c0 AS (SELECT row_number() OVER (ORDER BY h, e) - 1 AS num, e FROM (
      SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, e FROM v ORDER BY h, e LIMIT {CLUSTERS})),"""
    + "".join(_ASSIGN.format(i=i) + _MOVE.format(i=i, j=i + 1) for i in range(ROUNDS))
    + _ASSIGN.format(i=ROUNDS)
    + f"""
    t AS (SELECT num, sha256(array_to_string(e, ',')) AS centroid_sha256 FROM c{ROUNDS})
    SELECT a.vec_id, CAST(a.cluster AS INTEGER) AS cluster, a.distance,
      CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
      CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, t.centroid_sha256
    FROM a{ROUNDS} AS a JOIN t ON a.cluster = t.num"""
)
