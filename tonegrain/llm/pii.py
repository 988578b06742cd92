"""Personal data: pattern rules as seeds, bootstrapped contextual extraction for the rest.

Base spans are what four fixed rules find (e-mail, IPv4, card, phone). They are the seed
entities. Their contexts, the words around them, induce lexical patterns: the two words before,
the word on each side, the two words after. Every identifier-like token (it holds a
digit) is an instance of the patterns it stands in. On the graph of patterns and instances
Spark scores in rounds: a pattern's confidence for a kind is the scored share of its
distinct instances, shrunk by ``PRIOR``; an instance's score for a kind is the chance that at
least one of its patterns is right (noisy or). A round's patterns are those of enough distinct seeds, where
instances that the round before trusts are seeds as well, so contexts without any base seed come in.
Patterns of high confidence then name instances that no rule finds. Identifiers without a digit, of
fewer than 4 characters, or in texts without a digit or ``@`` are out of this method's reach.

Only counts per pattern and instance are shuffled; a frequent pattern is summed map-side.

Defined results: a null text is empty; empty texts have no span; repeated rows get equal
results; null ids are carried through; other columns pass through or are ignored whatever their
names are; an empty table gives no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegrain.llm.common import blob, stage

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
MIN_SEEDS = 3
PRIOR = 1.0
MIN_PATTERN, MIN_INSTANCE = 0.7, 0.8
#: Characters before and after a span in which its context words are looked for.
REACH = 64

# The base rules.
_MAIL_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_MAIL_HOST = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_TOKEN = re.compile(r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*")
_EDGE = "\"'()[]{}<>.,;:!?*#$%&|="
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

SPAN = "struct<kind:int,start:int,end:int>"
FOUND = f"row long, doc_id long, k1 long, k2 long, spans array<{SPAN}>, items array<struct<start:int,end:int,kind:int,name:long,patterns:array<long>>>"


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _mails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping e-mail spans; a match's name part reaches back from its ``@``."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _MAIL_NAME:
            start -= 1
        m = _MAIL_HOST.match(text, at) if start < at else None
        if m:
            done = m.end()
            out.append((start, done))
        at = text.find("@", max(at + 1, done))
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` by the fixed rules, sorted; positions are code points."""
    out = [(0, a, b) for a, b in _mails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        parts = m.group().split(".")
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m.group())) <= 15:
                out.append((3, *m.span()))
    return out


def _context(text: str, start: int, end: int) -> list[int]:
    """Hashes of the three patterns a span stands in."""
    before = ["^", "^", *_WORD.findall(text[max(0, start - REACH) : start])][-2:]
    after = [*_WORD.findall(text[end : end + REACH])[:2], "$", "$"][:2]
    b2, b1, a1, a2 = (re.sub("[0-9]", "0", w.strip(_EDGE).lower()) for w in (*before, *after))
    names = (f"{b2} {b1} _", f"{b1} _ {a1}", f"_ {a1} {a2}")
    return [xxhash.xxh64_intdigest(n.encode("utf-8", "replace")) - (1 << 63) for n in names]


def items(text: str, spans: list[tuple[int, int, int]]) -> list[tuple]:
    """Seeds and other identifier-like tokens with their patterns; kind -1 if no rule found it."""
    out, taken = [], sorted((a, b) for _, a, b in spans)
    for kind, a, b in spans:
        out.append((a, b, kind))
    i = 0
    for m in _TOKEN.finditer(text):
        token = m.group()
        a = m.start() + len(token) - len(token.lstrip(_EDGE))
        b = m.start() + len(token.rstrip(_EDGE))
        while i < len(taken) and taken[i][1] <= m.start():
            i += 1
        if b - a >= 4 and not any(x < m.end() and y > m.start() for x, y in taken[i : i + 4]):
            out.append((a, b, -1))
    return [
        (a, b, k, xxhash.xxh64_intdigest(text[a:b].encode("utf-8", "replace")) - (1 << 63), _context(text, a, b))
        for a, b, k in out
    ]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pair = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
    item = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("name", pa.int64()), ("patterns", pa.list_(pa.int64()))])
    digit = re.compile(rb"[0-9@]")
    for batch in batches:
        spans, found = [], []
        for text in batch.column(4):
            data = text.as_py()
            own, near = [], []
            if digit.search(data):
                data = data.decode("utf-8", "replace")
                own = base_spans(data)
                near = items(data, own)
            spans.append([dict(zip(("kind", "start", "end"), s)) for s in own])
            found.append([dict(zip(("start", "end", "kind", "name", "patterns"), s)) for s in near])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:4], pa.array(spans, pa.list_(pair)), pa.array(found, pa.list_(item))],
            names=["row", "doc_id", "k1", "k2", "spans", "items"],
        )


def _key(docs: DataFrame) -> tuple[Column, Column]:
    """Two hashes of id and text; rows that agree in both have the same spans."""
    name, text = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))
    return F.xxhash64(name, text), F.xxhash64(text, F.lit(5))


def extract(docs: DataFrame) -> DataFrame:
    """One line per row: base spans and items; written once."""
    k1, k2 = _key(docs)
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), k1.alias("k1"), k2.alias("k2"), blob("text").alias("text"))
    return stage(own.mapInArrow(_extract, FOUND), "pii-items")


def trusted(found: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Scored graph: ``(pattern, kind, confidence)`` and ``(name, kind, score)`` of what may be trusted."""
    each = found.select(F.explode("items").alias("i")).select("i.name", "i.kind", F.explode("i.patterns").alias("pattern"))
    edges = stage(each.groupBy("pattern", "name").agg(F.max("kind").alias("kind")), "pii-edges")
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("names"))
    seeds = edges.filter("kind >= 0").select("pattern", "kind", F.lit(1.0).alias("gain"), F.lit(1).alias("known"))
    scores = None
    for _ in range(rounds):
        members = seeds
        if scores is not None:
            named = edges.filter("kind < 0").select("pattern", "name").join(scores, "name")
            members = seeds.union(named.select("pattern", "kind", F.col("score").alias("gain"), (F.col("score") >= MIN_INSTANCE).cast("int").alias("known")))
        # Base seeds and what the last round trusts induce the patterns of this one.
        induced = members.groupBy("pattern", "kind").agg(F.sum("gain").alias("gain"), F.sum("known").alias("known")).filter(F.col("known") >= MIN_SEEDS)
        sure = induced.join(sizes, "pattern").withColumn("confidence", F.least(F.col("gain") / (F.col("names") + PRIOR), F.lit(0.99)))
        sure = stage(sure.select("pattern", "kind", "confidence"), "pii-confidence")
        doubt = (
            edges.filter("kind < 0").select("pattern", "name").join(sure, "pattern")
            .groupBy("name", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
        )
        scores = stage(doubt, "pii-scores")
    return sure.filter(F.col("confidence") >= MIN_PATTERN), scores.filter(F.col("score") >= MIN_INSTANCE)


def discovered(found: DataFrame) -> DataFrame:
    """``(row, k1, k2, more)``: spans that trusted patterns name in texts, none of them a base span."""
    patterns, names = trusted(found)
    open_ = (
        found.select("row", "k1", "k2", F.explode("items").alias("i")).filter("i.kind < 0")
        .select("row", "k1", "k2", "i.start", "i.end", "i.name", F.explode("i.patterns").alias("pattern"))
    )
    hit = open_.join(patterns, "pattern").join(names.select("name", F.col("kind").alias("kind")), ["name", "kind"])
    best = hit.groupBy("row", "k1", "k2", "start", "end").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    return best.groupBy("row", "k1", "k2").agg(F.collect_list(F.struct(F.col("kind").cast("int").alias("kind"), "start", "end")).alias("more"))


def find(docs: DataFrame) -> DataFrame:
    """``doc_id``, base ``spans`` and ``more`` spans of every row, as arrays of ``kind, start, end``."""
    found = extract(docs)
    more = discovered(found).select("row", "more")
    return found.select("row", "doc_id", "spans").join(more, "row", "left").select(
        "doc_id", "spans", F.coalesce("more", F.array().cast(f"array<{SPAN}>")).alias("more")
    )


def _redact(texts: pd.Series, more: pd.Series) -> pd.Series:
    out = []
    for text, extra in zip(texts, more, strict=True):
        if text is None:
            out.append(None)
            continue
        spans = base_spans(text) + [(s["kind"], s["start"], s["end"]) for s in (extra if extra is not None else [])]
        parts, done = [], 0
        for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
            if b <= done:
                continue
            parts += [text[done : max(a, done)], f"<{KINDS[kind].upper()}>"] if a >= done else []
            done = b
        out.append("".join(parts) + text[done:])
    return pd.Series(out, dtype=object)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind; all columns stay as they are else.

    Overlapping spans are replaced as one, by the kind of the first.
    """
    more = discovered(extract(docs)).groupBy("k1", "k2").agg(F.first("more").alias("_pii_more"))
    k1, k2 = _key(docs)
    keyed = docs.withColumns({"_pii_k1": k1, "_pii_k2": k2})
    joined = keyed.join(
        more.withColumnsRenamed({"k1": "_pii_k1", "k2": "_pii_k2"}), ["_pii_k1", "_pii_k2"], "left"
    )
    clean = F.pandas_udf(_redact, "string")(F.col("text"), F.col("_pii_more"))
    touched = F.col("text").rlike("[0-9@]")
    text = F.when(touched, clean).otherwise(F.col("text"))
    return joined.withColumn("text", text).select(*docs.columns)


def listed(spans: Column) -> Column:
    """Spans as text: ``kind:start:end`` by kind, then start, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])
        ), ",",
    )
