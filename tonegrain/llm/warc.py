"""WARC archives: write pages, and read archives by boundary-chain verification.

Writing: pages of equal payload share a digest; the one with the largest id becomes a ``response``,
the others ``revisit`` it. Records are Spark text rows that end with two line breaks, so
Spark's writer lays down valid archives on any file system.

Reading: archives are split at the record magic, so a task sees a range of a file as candidates: rows
that begin after a magic. Each gives its own offset and, from its header, that of its
successor. Offsets inside a range become offsets in the file once the sizes of the ranges
before it are added. Per file, pointer jumping from offset 0 marks what the chain
reaches, in log2 steps over two arrays of numbers; other candidates are magic inside a
payload, and their bytes go back to the record they lie in.

Defined results: a null page is empty; null urls become ``urn:unknown``; rows of equal id and payload are all responses
if that id is the largest, else all revisits; a null id is smaller than any other; pages of fewer
than ``min_bytes`` bytes are always responses; other columns are ignored whatever their
names are; an empty table writes an archive without records and reads no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonegrain.llm.common import stage
from tonegrain.sources.staging import new_path

MIN_BYTES = 0
#: Records per archive file.
FILE_RECORDS = 20_000
#: Lines of at most some 100 bytes that are few enough to be broadcast.
FEW = 200_000

# Fixed values of the format.
MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: four groups of 40 bits, eight digits each."""
    digits, hexes = [], F.sha1(data)
    for group in range(4):
        value = F.conv(F.substring(hexes, 10 * group + 1, 10), 16, 10).cast("long")
        for i in range(8):
            five = F.shiftright(value, 35 - 5 * i).bitwiseAND(F.lit(31))
            digits.append(F.substring(F.lit(BASE32), five.cast("int") + 1, F.lit(1)))
    return F.concat(*digits)


def records(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """One WARC record per row of ``pages(page_id, url, html)``, as text without its closing line breaks."""
    own = pages.select(
        F.col("page_id").cast("long"), F.coalesce("url", F.lit("urn:unknown")).alias("url"), F.coalesce("html", F.lit("")).alias("html")
    ).withColumns({"bytes": F.octet_length("html"), "sha": F.sha1("html")})
    # Only payloads that occur again need their response looked up.
    again = (
        own.select("page_id", "bytes", "sha").filter(F.col("bytes") >= min_bytes)
        .groupBy("bytes", "sha").agg(F.count("*").alias("n"), F.max("page_id").alias("response"))
        .filter("n > 1").select("bytes", "sha", "response")
    )
    again = stage(again, "warc-repeats")
    if again.count() <= FEW:  # then the pages themselves need not be shuffled
        again = F.broadcast(again)
    told = own.join(again, ["bytes", "sha"], "left").withColumn(
        "revisit", F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    )
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit(END)
    )
    block = F.when(F.col("revisit"), F.lit("")).otherwise(F.col("html"))
    ident = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    more = F.when(
        F.col("revisit"), F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", ident("response")))
    ).otherwise(F.lit(""))
    return told.select(
        F.concat(
            F.lit(MAGIC),
            line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
            line("WARC-Record-ID", ident("page_id")),
            line("WARC-Target-URI", F.regexp_replace("url", "[\\x00-\\x20]", "")),
            line("WARC-Date", F.lit(DATE)),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1_base32(F.col("html")))),
            more,
            line("Content-Type", F.lit("application/http; msgtype=response")),
            line("Content-Length", (F.octet_length(http) + F.octet_length(block)).cast("string")),
            F.lit("\r\n"), http, block,
        ).alias("value")
    )


def write(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> None:
    """Write archives to the folder ``path``."""
    records(pages, min_bytes).write.option("lineSep", END).option("maxRecordsPerFile", FILE_RECORDS).text(path)


PLACE = "file string, block long, at long, size long, skip long, length long"
CANDIDATES = (
    "file string, block long, at long, skip long, http long, length long, kind string, page_id long, "
    "refers_to long, payload_bytes long, digest string, value binary"
)


def _header(data: bytes) -> tuple | None:
    """Header size, size of the HTTP head, block length and fields of a record that begins after its magic."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for raw in data[:end].split(b"\r\n"):
        name, colon, value = raw.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip().decode("utf-8", "replace")
    if not fields.get(b"content-length", "").isdigit():
        return None
    http = data.find(b"\r\n\r\n", end + 4)
    http = 0 if http < 0 else http + 4 - (end + 4)
    inner = None
    for raw in data[end + 4 : end + 4 + http].split(b"\r\n"):
        if raw.lower().startswith(b"content-length:") and raw[15:].strip().isdigit():
            inner = int(raw[15:])
    number = lambda v: int(v[10:-1]) if v and v.startswith("<urn:page:") and v[10:-1].lstrip("-").isdigit() else None
    digest = fields.get(b"warc-payload-digest", "").removeprefix("sha1:")
    return (
        end + 4, http, int(fields[b"content-length"]), fields.get(b"warc-type"), number(fields.get(b"warc-record-id")),
        number(fields.get(b"warc-refers-to")), inner, digest,
    )


def _candidates(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Rows with their place in the range they were read from; if ``whole``, with fields and bytes."""
    number, text = pa.int64(), pa.string()
    place = [("file", text), ("block", number), ("at", number)]
    if whole:
        kinds = [*place, ("skip", number), ("http", number), ("length", number), ("kind", text), ("page_id", number), ("refers_to", number),
                 ("payload_bytes", number), ("digest", text), ("value", pa.binary())]
    else:
        kinds = [*place, ("size", number), ("skip", number), ("length", number)]
    schema = pa.schema(kinds)
    where, at = None, 0
    for batch in batches:
        out = []
        for file, block, value in zip(*batch.columns, strict=True):
            key, data = (file.as_py(), block.as_py()), value.as_py()
            if key != where:
                where, at = key, 0
            size = len(data) + len(MAGIC)
            head = _header(data) or (0, 0, -1, None, None, None, None, None)
            out.append((*key, at, *head, data) if whole else (*key, at, size, head[0], head[2]))
            at += size
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _reach(group: pd.DataFrame) -> pd.DataFrame:
    """Owner of each candidate of a file: the last record at or before it that the chain reaches."""
    group = group.sort_values("offset")
    offset, follows = group["offset"].to_numpy(), group["follows"].to_numpy()
    n = offset.size
    at = np.searchsorted(offset, follows)
    known = (at < n) & (offset[np.minimum(at, n - 1)] == follows) & (follows > offset)
    jump = np.append(np.where(known, at, n), n)
    reached = np.zeros(n + 1, bool)
    reached[0] = n > 0 and offset[0] == 0
    for _ in range(max(1, n.bit_length() + 1)):
        reached[jump[np.flatnonzero(reached)]] = True
        jump = jump[jump]
    mine = np.maximum.accumulate(np.where(reached[:n], np.arange(n), -1))
    owner = np.where(mine >= 0, offset[np.maximum(mine, 0)], -1)
    pieces = pd.Series(owner).groupby(owner).transform("size").to_numpy() if n else np.empty(0)
    return group[["file", "block", "at", "offset"]].assign(owner=owner, pieces=pieces)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, record_type, refers_to, payload, payload_bytes, payload_digest, verified`` of every reachable record.

    Archives are read twice, so nothing but numbers and odd records is shuffled; the second pass
    is lazy and must see the same split settings. ``payload`` is null for revisits. ``verified`` says that the payload's digest and size are the header's.
    """
    text = spark.read.option("lineSep", MAGIC).text(path)
    rows = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary"))
    seen = stage(rows.mapInArrow(partial(_candidates, whole=False), PLACE), "warc-candidates")
    ranges = seen.groupBy("file", "block").agg(F.sum("size").alias("bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranges.select("file", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    # The magic of a row ends where the row begins.
    placed = seen.join(bases, ["file", "block"]).withColumn("offset", F.col("base") + F.col("at") - len(MAGIC))
    follows = F.when(F.col("length") >= 0, F.col("offset") + len(MAGIC) + F.col("skip") + F.col("length") + len(END)).otherwise(-1)
    chain = (
        placed.filter("offset >= 0").select("file", "block", "at", "offset", follows.alias("follows"))
        .groupBy("file").applyInPandas(_reach, "file string, block long, at long, offset long, owner long, pieces long")
    )
    # A candidate that is a record by itself needs nothing more; the others are few as a rule.
    odd = stage(chain.filter("owner < 0 or pieces > 1").drop("pieces"), "warc-odd")
    few = odd.count()
    first = (F.col("block") == 0) & (F.col("at") == 0)  # what stands before the first magic
    records_ = rows.mapInArrow(partial(_candidates, whole=True), CANDIDATES).filter(~first)
    marked = records_.join(F.broadcast(odd) if few <= FEW else odd, ["file", "block", "at"], "left")
    fields = ["kind", "page_id", "refers_to", "payload_bytes", "digest", "skip", "http", "length"]
    whole = marked.filter("owner is null").select(*fields, "value")
    head = lambda c: F.max(F.when(F.col("offset") == F.col("owner"), F.col(c))).alias(c)
    magic = F.lit(MAGIC).cast("binary")
    joined = (
        marked.filter("owner >= 0").groupBy("file", "owner").agg(
            *[head(c) for c in fields], F.array_sort(F.collect_list(F.struct("offset", "value"))).alias("parts"),
        )
        .withColumn("value", F.aggregate(
            F.slice("parts", 2, F.size("parts")), F.element_at("parts", 1)["value"], lambda a, x: F.concat(a, magic, x["value"])
        ))
        .select(*fields, "value")
    )
    payload = F.expr("substring(value, cast(skip + http + 1 as int), cast(length - http as int))")
    out = (whole.union(joined) if few else whole).withColumn("payload", F.when(F.col("kind") == "response", payload))
    same = (F.octet_length("payload") == F.col("payload_bytes")) & (sha1_base32(F.col("payload")) == F.col("digest"))
    return out.select(
        "page_id", F.col("kind").alias("record_type"), "refers_to", "payload", "payload_bytes", F.col("digest").alias("payload_digest"),
        (F.col("payload").isNull() | same).alias("verified"),
    )


def round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path, min_bytes)
    return read(spark, path)
