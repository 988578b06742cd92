"""Collocations by SON partitioning: shards mined at a lowered support, candidates counted exactly.

Texts are lower-cased (A-Z), cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words ``[^\\x20\\x09]+``. A phrase is
one to ``MOST_WORDS`` words in a row inside a piece.

1. The corpus is dealt into ``SHARDS`` shards, by task. Every phrase of a shard is counted in it, by a hash of language and
   phrase: tasks count what they read, and their counts meet by ranges of the hash. A phrase seen ``SUPPORT`` times has at least ``SUPPORT / SHARDS``
   occurrences in some shard, so what no shard has that often is out. Two phrases of one hash are counted together,
   which can only let more of them through.
2. The hashes of all shards are united in a bitmap of ``BITS`` bits, which has a fixed size whatever the corpus; a bit that
   phrases share lets more of them through as well.
3. A second pass counts the phrases the bitmap lets through, by their text, over the whole corpus. These counts are
   exact, and complete for all phrases seen ``SUPPORT`` times.

The scores are joins of the counted phrases with their own parts. Parts that many phrases share (the most frequent words)
are joined by broadcast, at most ``HOT_PARTS`` lines of a digest and a count; the others by shuffle. Ranks are first found in slices
of a language, so that no task sees more of one than its share.

Defined results: a null text is empty; a null language is ``und``; repeated rows count again, as do overlapping
occurrences; a null id does not matter; texts are read whole, whatever their length; other columns are ignored
whatever their names are; an empty table, or one without frequent phrases, gives no row.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonegrain.llm.common import blob, mix64, stage

MOST_WORDS = 3
SUPPORT = 10
SHARDS = 4
#: Bits of the candidates' bitmap: 32 MB.
BITS = 1 << 28
#: Of ``bitmap_construct_agg``: bits in one of its buckets.
BUCKET = 1 << 15
NESTED = 50
TOP = 2000
SCALE = 1_000_000
#: Word occurrences counted together in a task.
HELD = 1 << 19
#: Words numbered in a task before it starts anew; with HELD more of them numbers stay below 21 bits.
KNOWN_WORDS = 1 << 19
#: Bytes of text whose phrases are added up at one place.
RANGE_BYTES = 1 << 23
#: Bits of a phrase's hash.
KEY_BITS = 48
HOT_PARTS = 10_000
SLICES = 64

# Separators become a word of their own, which no word of a text can be.
CUT = b"."
_TABLE = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\x09", CUT * 10 + b" ")
# A phrase is a number of up to three word numbers of 21 bits.
_SHIFT = 21


def words_of(text: bytes) -> list[bytes]:
    """The words of a text in order, pieces set apart by ``CUT``."""
    return text.lower().translate(_TABLE).replace(CUT, b" " + CUT + b" ").split()


class _Counter:
    """Phrases of a task: words are numbered, numbers of phrases are counted in numpy, language by language."""

    def __init__(self) -> None:
        self.texts: dict[str, list[tuple[np.ndarray, int]]] = {}
        self.held = 0
        self._renumber()

    def _renumber(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.number[CUT]
        self.hashed = np.empty(0, np.uint64)

    def words(self) -> list[bytes]:
        return list(self.number)

    def add(self, lang: str, text: bytes) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """Take a text in; gives ``(lang, phrases, counts)`` whenever enough is held."""
        words = words_of(text)
        for lo in range(0, max(len(words), 1), HELD):
            # A slice goes on into the next by the words that its last phrases need.
            part = words[lo : lo + HELD + MOST_WORDS - 1]
            if self.held + len(part) > HELD:
                yield from self.flush()
            number = self.number
            self.texts.setdefault(lang, []).append((np.array([number[w] for w in part], np.int64), min(HELD, len(words) - lo)))
            self.held += len(part)

    def flush(self) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        for lang, parts in self.texts.items():
            gap = np.zeros(MOST_WORDS, np.int64)
            ids = np.concatenate([x for part, _ in parts for x in (part, gap)])
            first = np.concatenate([x for part, own in parts for x in (np.arange(len(part)) < own, gap > 0)])
            phrase, whole = ids, (ids > 0) & first
            keys = [phrase[whole]]
            for k in range(1, MOST_WORDS):
                later = np.append(ids[k:], np.zeros(k, np.int64))
                whole = whole & (later > 0)
                phrase = phrase | later << _SHIFT * k
                keys.append(phrase[whole])
            yield lang, *np.unique(np.concatenate(keys), return_counts=True)
        self.texts.clear()
        self.held = 0
        if len(self.number) > KNOWN_WORDS:
            self._renumber()

    def hashes(self, lang: str, ids: np.ndarray) -> np.ndarray:
        """Hashes of language and phrase, ``KEY_BITS`` long."""
        new = [_hash(w) for w in self.words()[len(self.hashed):]]
        self.hashed = np.append(self.hashed, np.array(new, np.uint64))
        out = np.full(len(ids), _hash(b"lang " + lang.encode()), np.uint64)
        for k in range(ids.shape[1]):
            met = np.flatnonzero(ids[:, k])
            out[met] = mix64(out[met] * np.uint64(0x9E3779B97F4A7C15) + self.hashed[ids[met, k]])
        return out >> np.uint64(64 - KEY_BITS)


def _ids(phrases: np.ndarray) -> np.ndarray:
    """Word numbers of phrases, a line each, 0 for none."""
    return np.stack([(phrases >> _SHIFT * k) & ((1 << _SHIFT) - 1) for k in range(MOST_WORDS)], axis=1)


def _hash(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys as the first and the steps to the next, in 32 bits if they fit."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return keys[:1].tobytes() + (steps[1:].astype(np.uint32) if (steps[1:] < 1 << 32).all() else steps[1:]).tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    steps = np.frombuffer(data, np.uint32 if len(data) == 4 * n + 4 else np.uint64, offset=8)
    return np.cumsum(np.concatenate([np.frombuffer(data, np.uint64, 1), steps]), dtype=np.uint64)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), blob("text").alias("text"))


def _flushes(batches: Iterator[pa.RecordBatch], counter: _Counter) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield from counter.add(lang, text.as_py())
    yield from counter.flush()


def shard_candidates(docs: DataFrame, shards: int = SHARDS, support: int = SUPPORT) -> DataFrame:
    """``key``: hashes of the phrases that are frequent in some shard, each once.

    Tasks send sorted runs of hashes and counts, a run for each range of hashes; a range is as small as to
    hold about ``RANGE_BYTES / 2`` phrases of the corpus, and is added up at one place.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits, small = (size // RANGE_BYTES).bit_length(), np.min_scalar_type(support)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, shard = _Counter(), TaskContext.get().partitionId() % shards
        for lang, phrases, counts in _flushes(batches, counter):
            key = counter.hashes(lang, _ids(phrases))
            order = np.argsort(key)
            # A count above the support says no more than the support.
            key, counts = key[order], np.minimum(counts[order], support).astype(small)
            at = (key >> np.uint64(KEY_BITS - bits)).astype(np.int64)
            edges = np.flatnonzero(np.diff(at, prepend=-1, append=-1)) if key.size else np.zeros(1, np.int64)
            runs = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([
                pa.array(at[edges[:-1]]), pa.array(np.full(len(runs), shard, np.int32)),
                pa.array([_packed(key[lo:hi]) for lo, hi in runs], pa.binary()), pa.array([counts[lo:hi].tobytes() for lo, hi in runs], pa.binary()),
            ], names=["at", "shard", "keys", "counts"])

    def often(group: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, own in group.groupby("shard"):
            c = np.frombuffer(b"".join(own["counts"]), small)
            key = np.concatenate([_unpacked(x, len(n) // small.itemsize) for x, n in zip(own["keys"], own["counts"], strict=True)])
            order = np.argsort(key)
            key = key[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            total = np.add.reduceat(c[order].astype(np.int64), first)
            found.append(key[first][total * shards >= support])
        return pd.DataFrame({"key": np.unique(np.concatenate(found)).view(np.int64)})

    own = _texts(docs).mapInArrow(count, "at long, shard int, keys binary, counts binary")
    return own.groupBy("at").applyInPandas(often, "key long")


def bitmap_of(keys: DataFrame, bits: int = BITS) -> np.ndarray:
    """A bitmap with a bit for every key: ``bits / 8`` bytes, whatever the number of keys."""
    slot = F.pmod("key", F.lit(bits))
    buckets = (
        keys.select(F.floor(slot / BUCKET).cast("long").alias("bucket"), F.pmod(slot, F.lit(BUCKET)).alias("bit"))
        .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("held"))
    )
    out = np.zeros(bits // 8, np.uint8)
    for r in buckets.toLocalIterator():
        lo = r["bucket"] * (BUCKET // 8)
        out[lo : lo + BUCKET // 8] = np.frombuffer(r["held"], np.uint8)[: BUCKET // 8]
    return out


def count_phrases(docs: DataFrame, shards: int = SHARDS, support: int = SUPPORT, bits: int = BITS) -> DataFrame:
    """``lang, phrase, k, f`` of all phrases seen ``support`` times, and ``lang, null, 0, n`` of all words; written once."""
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap_of(shard_candidates(docs, shards, support), bits))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, held, total = _Counter(), bitmap.value, defaultdict(int)
        schema = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("k", pa.int32()), ("f", pa.int64())])
        for lang, phrases, counts in _flushes(batches, counter):
            ids, word = _ids(phrases), pa.array(counter.words(), pa.binary())
            total[lang] += int(counts[(ids[:, 1:] == 0).all(axis=1)].sum())
            slot = counter.hashes(lang, ids) % np.uint64(bits)
            kept = (held[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0
            ids, c = ids[kept], counts[kept]
            size = (ids > 0).sum(axis=1)
            for k in range(1, MOST_WORDS + 1):
                own = size == k
                parts = [word.take(pa.array(ids[own, i])) for i in range(k)]
                text = pc.binary_join_element_wise(*parts, b" ") if k > 1 else parts[0]
                n = len(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * n, pa.string()), text, pa.array(np.full(n, k, np.int32)), pa.array(c[own].astype(np.int64))], schema=schema
                )
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, f.type) for x, f in zip([list(total), [None] * len(total), [0] * len(total), list(total.values())], schema)], schema=schema
        )

    own = _texts(docs).mapInArrow(count, "lang string, phrase binary, k int, f long")
    counted = own.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f")).filter((F.col("f") >= support) | (F.col("k") == 0))
    return stage(counted.withColumn("phrase", F.col("phrase").cast("string")), "phrase-counts")


def _digest(lang: str, phrase: str):
    return F.unhex(F.md5(F.concat_ws("\n", lang, phrase).cast("binary")))


def _with_parts(cuts: DataFrame, parts: DataFrame, part: str, name: str) -> DataFrame:
    """``cuts`` with the count of the phrase in column ``part`` as ``name``; parts that many share are broadcast.

    ``cuts`` is written. Every part has a count, as it is at least as frequent as its phrase.
    """
    own = cuts.withColumn("part", _digest("lang", part)).drop(part)
    total = own.agg(F.count("*")).scalar()
    # More than a 10,000th of all lines each, so 10,000 of them at most.
    hot = own.groupBy("part").agg(F.count("*").alias("lines")).filter(F.col("lines") * HOT_PARTS > total).select("part")
    counts = parts.select("part", F.col("f").alias(name))
    hot = F.broadcast(stage(counts.join(F.broadcast(hot), "part"), "hot-parts"))
    rest = own.join(hot.select("part"), "part", "left_anti").join(counts, "part")
    return own.join(hot, "part").unionByName(rest).drop("part")


def mine(docs: DataFrame, shards: int = SHARDS, support: int = SUPPORT, bits: int = BITS, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the best phrases of each language."""
    counted = count_phrases(docs, shards, support, bits)
    totals = counted.filter("k = 0").select("lang", F.col("f").alias("n"))
    frequent = counted.filter("k > 0").select("lang", "phrase", "k", F.col("f").alias("a"))
    parts = frequent.filter(F.col("k") < MOST_WORDS).select(_digest("lang", "phrase").alias("part"), F.col("a").alias("f"))
    parts = stage(parts, "phrase-parts")
    # A phrase goes if a longer one that holds it has half of its occurrences.
    words = F.split("phrase", " ")
    inside = F.transform(F.sequence(F.lit(1), F.lit(2)), lambda i: F.array_join(F.slice(words, i, F.col("k") - 1), " "))
    longer = frequent.filter(F.col("k") == MOST_WORDS).select("lang", F.explode(F.array_distinct(inside)).alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = (
        frequent.filter("k > 1").join(longer, ["lang", "phrase"], "left")
        .filter(F.col("longer").isNull() | (100 * F.col("longer") < NESTED * F.col("a"))).drop("longer")
    )
    cuts = kept.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).withColumns({
        "left": F.array_join(F.slice(words, F.lit(1), F.col("cut")), " "),
        "right": F.array_join(F.slice(words, F.col("cut") + 1, F.col("k") - F.col("cut")), " "),
    })
    cuts = stage(cuts.select("lang", "phrase", "a", "cut", "left", "right"), "phrase-cuts")
    cuts = stage(_with_parts(cuts, parts, "left", "l"), "phrase-cuts")
    cuts = _with_parts(cuts, parts, "right", "r")
    # Products of up to 38 digits; div gives their exact whole quotient.
    exact = {c: F.col(c).cast("decimal(15,0)") for c in ("a", "l", "r")}
    score = F.expr(f"CAST((CAST({SCALE} AS decimal(7,0)) * xa * xa) div (xl * xr) AS BIGINT)")
    cuts = cuts.withColumns({"x" + c: x for c, x in exact.items()}).withColumn("score", score)
    worst = F.min(F.struct("score", "cut", "l", "r"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(worst.alias("w")).select("lang", "phrase", "a", "w.l", "w.r", "w.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    in_slice = Window.partitionBy("lang", "slice").orderBy(*order)
    best = scored.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES))).withColumn("rank", F.row_number().over(in_slice))
    best = best.filter(F.col("rank") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    # One line per language, and top lines of each: sizes that the ranks bound.
    return best.filter(F.col("rank") <= top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same in DuckDB, all phrases counted at once.
SQL = rf"""
    WITH d AS (SELECT coalesce(lang, 'und') AS lang,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    p AS (SELECT lang, regexp_extract_all(unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
    g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
      FROM p, (VALUES (1), (2), (3)) AS s(k) WHERE len(w) >= k),
    f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
    n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
    c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= {SUPPORT}),
    o AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3),
    x AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.lang = c.lang AND o.phrase = c.phrase AND 100 * o.a >= {NESTED} * c.a)),
    cuts AS (SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS u, array_to_string(w[cut + 1:], ' ') AS v
      FROM x, (VALUES (1), (2)) AS s(cut) WHERE cut < k),
    s AS (SELECT cuts.*, l.f AS l, r.f AS r,
        CAST(CAST({SCALE} AS HUGEINT) * a * a // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
      FROM cuts JOIN f AS l ON l.lang = cuts.lang AND l.phrase = cuts.u JOIN f AS r ON r.lang = cuts.lang AND r.phrase = cuts.v),
    b AS (SELECT lang, phrase, a, min({{'score': score, 'cut': cut, 'l': l, 'r': r}}) AS w FROM s GROUP BY ALL),
    z AS (SELECT lang, phrase, a, w.l AS l, w.r AS r, w.score AS score,
        row_number() OVER (PARTITION BY lang ORDER BY w.score DESC, a DESC, phrase) AS rank FROM b)
    SELECT z.lang, z.rank, z.phrase, z.a, z.l, z.r, n.n, z.score FROM z JOIN n USING (lang) WHERE rank <= {TOP}"""
