"""URL filter: fixed host and path rules, and association rules mined by FP-growth for the rest.

A URL is a set of at most nine tokens, one of a kind: scheme, top domain, site, first host label, host,
first folder, last path segment (digit runs as ``0``), names of the query's parameters, and whether there is
a fragment. A token over ``LONG`` characters becomes its MD5. The fixed rules label the URLs they fit; MLlib's
FP-growth mines which tokens come together with which label. Of the frequent sets of at most ``MOST_TOKENS`` tokens, those become
rules whose share of one label is at least ``CONFIDENCE``, on at least ``SUPPORT`` of the labelled URLs
(and ``LEAST_ROWS``); a rule goes if fewer of its tokens do as well. Each rule is indexed under its rarest
token; a URL looks up its tokens, checks the rules found, and takes the best one: the most
confident, then the most frequent, the shortest, the first as text. Without one it is allowed.

As a URL has nine tokens, it holds at most 129 sets of three or less, so there are never more than
``129 / SUPPORT`` rules however large the table; that bounds the broadcast index.

Only DataFrame operations and MLlib run here; the driver sees the number of labelled URLs.

Defined results: a null URL, or one without ``://``, has empty host and path, no tokens and no rule, and is allowed;
repeated rows and null ids are judged each on their own; without labelled URLs nothing is mined; other
columns are ignored whatever their names are; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegrain.llm.common import stage

ALLOW, BLOCK = "allow", "block"

# Host, path and verdict of the rules.
RULES = (
    ("com", "/", ALLOW),
    ("example.com", "/en/", BLOCK),
    ("www.example.com", "/en/", ALLOW),
    ("net", "/es/", BLOCK),
    ("net", "/fr/", BLOCK),
)

MOST_TOKENS = 3
SUPPORT, LEAST_ROWS = 0.002, 5
#: In millionths, as all shares here, so that they are whole numbers.
CONFIDENCE = 900_000
LONG = 100
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_VERDICT = "verdict:"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def fixed_rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; both null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for own, start, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        rule, verdict = F.when(fits, own + start).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """The sorted tokens of a URL; none if it has no host."""
    labels, folders = F.split(host, r"\."), F.split(path, "/")
    page = F.split_part(url, F.lit("#"), F.lit(1))
    query = F.regexp_replace(F.regexp_extract(page, r"(?s)\?(.*)", 1), "=[^&]*", "")
    last = F.regexp_replace(F.element_at(folders, -1), "[0-9]+", "0")
    n = F.size(labels)

    def token(kind: str, value: Column, there: Column) -> Column:
        short = F.when(F.length(value) > LONG, F.md5(value)).otherwise(value)
        return F.when(there, F.concat(F.lit(kind + ":"), short))

    found = F.array(
        token("scheme", F.split_part(url, F.lit("://"), F.lit(1)), F.lit(True)),
        token("tld", F.element_at(labels, -1), F.lit(True)),
        token("site", F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), "."), n >= 2),
        token("sub", F.get(labels, F.lit(0)), n >= 3),
        token("host", host, F.lit(True)),
        token("dir", F.get(folders, F.lit(1)), F.size(folders) >= 3),
        token("file", last, (F.size(folders) >= 2) & (last != "")),
        token("query", query, query != ""),
        token("mark", F.lit("#"), F.instr(url, "#") > 0),
    )
    return F.when(host != "", F.array_sort(F.filter(found, lambda t: t.isNotNull()))).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame) -> DataFrame | None:
    """``tokens, verdict, confidence, hits`` of the rules of ``labelled(tokens, verdict)``; None without rows.

    ``labelled`` is read more than once: stage it.
    """
    n = labelled.count()
    if not n:
        return None
    least = max(LEAST_ROWS, -(-n * round(SUPPORT * 1_000_000) // 1_000_000))
    items = labelled.select(F.concat("tokens", F.array(F.concat(F.lit(_VERDICT), "verdict"))).alias("items"))
    # MLlib rounds its count up; half a row less keeps that from passing the count meant.
    sets = FPGrowth(itemsCol="items", minSupport=max(0.0, (least - 0.5) / n)).fit(items).freqItemsets
    sets = sets.select(
        F.array_sort(F.filter("items", lambda t: ~t.startswith(_VERDICT))).alias("tokens"),
        F.get(F.filter("items", lambda t: t.startswith(_VERDICT)), F.lit(0)).alias("label"),
        "freq",
    ).filter(F.size("tokens").between(1, MOST_TOKENS))
    sets = stage(sets, "url-sets")
    bodies = sets.filter("label is null").select("tokens", F.col("freq").alias("rows"))
    hits = sets.filter("label is not null").select("tokens", F.substring("label", len(_VERDICT) + 1, 10).alias("verdict"), F.col("freq").alias("hits"))
    share = F.expr("hits * 1000000 div rows")
    rules = hits.join(bodies, "tokens").select("tokens", "verdict", share.alias("confidence"), "hits").filter(F.col("confidence") >= CONFIDENCE)
    rules = stage(rules, "url-rules")
    fewer = F.filter(
        F.concat(
            F.transform("tokens", lambda t: F.array(t)),
            F.transform("tokens", lambda t: F.array_remove(F.col("tokens"), t)),
        ),
        lambda s: (F.size(s) > 0) & (F.size(s) < F.size("tokens")),
    )
    simpler = rules.select(F.col("tokens").alias("fewer"), "verdict", F.col("confidence").alias("simpler"))
    covered = (
        rules.withColumn("fewer", F.explode(fewer)).join(simpler, ["fewer", "verdict"])
        .filter(F.col("simpler") >= F.col("confidence")).select("tokens").distinct()
    )
    kept = rules.join(covered, "tokens", "left_anti")
    counts = bodies.filter(F.size("tokens") == 1).select(F.get("tokens", F.lit(0)).alias("token"), "rows")
    rarest = (
        kept.withColumn("token", F.explode("tokens")).join(counts, "token")
        .groupBy("tokens").agg(F.min(F.struct("rows", "token"))["token"].alias("probe"))
    )
    return stage(kept.join(rarest, "tokens").coalesce(1), "url-index")


def judge(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, mined, confidence`` for every row of ``pages(page_id, url)``.

    ``mined`` is the association rule that fits best, as text, and ``confidence`` its share in millionths.
    """
    url = F.coalesce("url", F.lit(""))
    parts = pages.select("page_id", url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    urls = parts.select(
        "page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"),
        tokens_of(F.col("url"), F.col("host"), F.col("path")).alias("tokens"),
    )
    index = mine(stage(urls.filter("verdict is not null").select("tokens", "verdict"), "url-labels"))
    if index is None:
        none = F.lit(None)
        return urls.select(
            "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(ALLOW)).alias("verdict"),
            none.cast("string").alias("mined"), none.cast("long").alias("confidence"),
        )
    index = F.broadcast(index.select("probe", F.col("tokens").alias("needs"), F.col("verdict").alias("says"), "confidence", "hits"))
    met = urls.withColumn("row", F.monotonically_increasing_id()).withColumn("token", F.explode_outer("tokens"))
    met = met.join(index, F.col("token") == F.col("probe"), "left")
    fits = F.forall("needs", lambda t: F.array_contains(F.col("tokens"), t))
    best = F.struct(
        (-F.col("confidence")).alias("confidence"), (-F.col("hits")).alias("hits"), F.size("needs").alias("size"),
        F.array_join("needs", " & ").alias("text"), F.col("says").alias("verdict"),
    )
    return met.groupBy("row", "page_id", "host", "path", "rule", "verdict").agg(F.min(F.when(fits, best)).alias("best")).select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", "best.verdict", F.lit(ALLOW)).alias("verdict"),
        F.col("best.text").alias("mined"), (-F.col("best.confidence")).alias("confidence"),
    )


#: The same in DuckDB; all token sets up to three are counted there by joins.
SQL = rf"""
    WITH RECURSIVE u AS (SELECT row_number() OVER () AS id, page_id, coalesce(url, '') AS url FROM pages),
    p AS (SELECT *, translate(regexp_extract(url, '{_PARTS}', 1), '{UPPER}', '{LOWER}') AS host,
      regexp_extract(url, '{_PARTS}', 2) AS path FROM u),
    r(own, start, says) AS (VALUES {", ".join(f"('{h}', '{s}', '{v}')" for h, s, v in RULES)}),
    b AS (SELECT p.id, max_by(r.own || r.start, length(r.own || r.start)) AS rule, max_by(r.says, length(r.own || r.start)) AS says
      FROM p JOIN r ON (p.host = r.own OR ends_with(p.host, '.' || r.own)) AND starts_with(p.path, r.start) GROUP BY p.id),
    q AS (SELECT *, string_split(host, '.') AS labels, string_split(path, '/') AS folders,
      regexp_replace(regexp_extract(split_part(url, '#', 1), '(?s)\?(.*)', 1), '=[^&]*', '', 'g') AS query,
      regexp_replace(split_part(path, '/', -1), '[0-9]+', '0', 'g') AS last FROM p),
    k AS (SELECT id, unnest([
        {{'kind': 'scheme', 'v': split_part(url, '://', 1), 'ok': true}}, {{'kind': 'tld', 'v': labels[-1], 'ok': true}},
        {{'kind': 'site', 'v': array_to_string(labels[-2:], '.'), 'ok': len(labels) >= 2}},
        {{'kind': 'sub', 'v': labels[1], 'ok': len(labels) >= 3}}, {{'kind': 'host', 'v': host, 'ok': true}},
        {{'kind': 'dir', 'v': folders[2], 'ok': len(folders) >= 3}},
        {{'kind': 'file', 'v': last, 'ok': len(folders) >= 2 AND last <> ''}},
        {{'kind': 'query', 'v': query, 'ok': query <> ''}}, {{'kind': 'mark', 'v': '#', 'ok': contains(url, '#')}}], recursive := true)
      FROM q WHERE host <> ''),
    t AS (SELECT id, kind || ':' || CASE WHEN length(v) > {LONG} THEN md5(v) ELSE v END AS token FROM k WHERE ok),
    s AS (SELECT id, [token] AS tokens, token AS top FROM t
      UNION ALL SELECT s.id, list_append(s.tokens, t.token), t.token FROM s JOIN t ON s.id = t.id AND t.token > s.top WHERE len(s.tokens) < {MOST_TOKENS}),
    l AS (SELECT s.tokens, b.says FROM s JOIN b USING (id)),
    n AS (SELECT greatest({LEAST_ROWS}, -((-count(*) * {round(SUPPORT * 1_000_000)}) // 1000000)) AS least FROM b),
    c AS (SELECT tokens, says, hits, CAST(sum(hits) OVER (PARTITION BY tokens) AS BIGINT) AS rows
      FROM (SELECT tokens, says, count(*) AS hits FROM l GROUP BY ALL)),
    g AS (SELECT tokens, says, hits, hits * 1000000 // rows AS confidence FROM c, n
      WHERE hits >= least AND hits * 1000000 // rows >= {CONFIDENCE}),
    w AS (SELECT g.* FROM g WHERE NOT EXISTS (SELECT 1 FROM g AS o WHERE o.says = g.says AND len(o.tokens) < len(g.tokens)
      AND list_has_all(g.tokens, o.tokens) AND o.confidence >= g.confidence)),
    m AS (SELECT s.id, min({{'confidence': -w.confidence, 'hits': -w.hits, 'size': len(w.tokens),
      'text': array_to_string(w.tokens, ' & '), 'says': w.says}}) AS best FROM s JOIN w ON s.tokens = w.tokens GROUP BY s.id)
    SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.says, m.best.says, '{ALLOW}') AS verdict, m.best.text AS mined,
      -m.best.confidence AS confidence
    FROM p LEFT JOIN b USING (id) LEFT JOIN m USING (id)"""
