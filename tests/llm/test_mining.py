"""Centroids, phrases and URL rules against plain Python."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest

from tests_llm_helpers import prose
from tonegrain.llm import clusters, phrases, url_rules

VECTORS = "vec_id long, embedding array<double>, label int, planes binary, cluster int, distance long"


def kmeans_by_force(rows, k=16, rounds=3):
    """``(vec_id, cluster, distance)`` of each kept row, and the centroids, in Python's whole numbers."""
    own = [
        (i, [math.floor(64 * x) for x in e]) for i, e in rows
        if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)
    ]
    order = sorted(own, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]

    def assign():
        out = []
        for i, v in own:
            away = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres]
            out.append((i, away.index(min(away)), min(away)))
        return out

    for _ in range(rounds):
        members = collections.defaultdict(list)
        for (_, c, _), (_, v) in zip(assign(), own):
            members[c].append(v)
        centres = [[sum(x) // len(members[i]) for x in zip(*members[i])] if members[i] else c for i, c in enumerate(centres)]
    return assign(), centres


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, 1, b"x", 7, 8) for i, e in rows], VECTORS).repartition(4)


def compare(spark, rows):
    placed, centres = kmeans_by_force(rows)
    got = clusters.cluster(vectors(spark, rows)).collect()
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=repr) == sorted(placed, key=repr)
    total, own = sum(d for _, _, d in placed), collections.Counter()
    for _, c, d in placed:
        own[c] += d
    for r in got:
        assert (r["inertia"], r["cluster_inertia"]) == (total, own[r["cluster"]])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centres[r["cluster"]])).encode()).hexdigest()


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(9, 64))[rng.integers(0, 9, 300)] + rng.normal(size=(300, 64)) * 0.3
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [(900, None), (901, []), (902, [0.5] * 63), (903, [None] * 64), (904, [float("nan")] * 64), (905, [float("-inf")] * 64)]
    compare(spark, rows + odd + [(906, [0.0] * 64), (907, [-0.0] * 64), (None, [0.25] * 64), (None, [0.2] * 64), (906, [1.0] * 64)])


def test_clusters_of_few_equal_and_large_vectors(spark):
    compare(spark, [(i, [i - 2.5] * 64) for i in range(5)])  # fewer than 16
    compare(spark, [(i % 7, [0.5] * 64) for i in range(40)])  # one vector, ids repeat: only ties
    compare(spark, [(i, [(-1) ** j * 10_000.0 * (i + 1) + i for j in range(64)]) for i in range(30)])  # many planes
    compare(spark, [(i, [0.01 * i] * 64 if i % 2 else [3000.0 * i] * 64) for i in range(40)])  # widths differ by batch
    assert clusters.cluster(vectors(spark, [])).count() == 0
    (beyond,) = clusters.cluster(vectors(spark, [(1, [1e300] * 64)])).collect()
    assert beyond["distance"] == 0


def test_planes_hold_their_numbers():
    rng = np.random.default_rng(5)
    for bits in (1, 2, 7, 13, 27):
        a, b = (rng.integers(-(1 << (bits - 1)), 1 << (bits - 1), (20, 64)) for _ in range(2))
        pa, pb = clusters.planes_of(a), clusters.planes_of(b)
        assert pa.shape[1] <= bits and (clusters.numbers_of(pa) == a).all()
        assert (clusters.dots(pa, pb) == a @ b.T).all() and (clusters.norms(pa) == (a * a).sum(axis=1)).all()


def phrases_by_force(rows, support, top):
    """Lines of the result, by lang and rank."""
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    often = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= support}
    found = collections.defaultdict(list)
    for (lang, p), a in often.items():
        if len(p) == 2 and any(
            100 * b >= 50 * a for (other, q), b in often.items() if other == lang and len(q) == 3 and p in (q[:2], q[1:])
        ):
            continue
        cuts = []
        for k in range(1, len(p)):
            left, right = f[lang, p[:k]], f[lang, p[k:]]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        found[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted(
        (lang, i + 1, p.decode(), -a, left, right, n[lang], -s)
        for lang, lines in found.items() for i, (s, a, p, left, right) in enumerate(sorted(lines)[:top])
    )


def check_phrases(spark, rows, **how):
    docs = spark.createDataFrame([(1, t, g, 3, "w", 4) for g, t in rows], "doc_id long, text string, lang string, k int, phrase string, f int")
    got = phrases.mine(docs.repartition(5), **how)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = phrases_by_force(rows, how.get("support", phrases.SUPPORT), how.get("top", phrases.TOP))
    assert sorted(tuple(r) for r in got.collect()) == want
    return want


def test_phrases_equal_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.choice(["en", "de", None]), " ".join(rng.choice(["a", "B", "c.", "d,", "é", "new york", "San Francisco bay", "x\ty"]) for _ in range(60))) for _ in range(50)]
    rows += [("en", None), (None, ""), ("de", " .,;: \t"), ("en", "a a a a a a a a a a a a a a"), ("zz", "one two"), ("und", "a c. a c. A\x0bC")]
    assert len(check_phrases(spark, rows)) > 50
    check_phrases(spark, rows, top=3)
    monkeypatch.setattr(phrases, "HELD", 16)  # many flushes, long texts in slices
    check_phrases(spark, rows, support=7, shards=3)
    check_phrases(spark, rows, bits=1 << 16)
    assert check_phrases(spark, rows[-2:]) == []


def test_a_phrase_spread_over_all_shards_is_found(spark):
    # Ten times, in ten texts; nothing else repeats.
    rows = [("en", f"{prose(i, 40, 10**9)} rare pair {prose(i + 50, 40, 10**9)}") for i in range(10)]
    (line,) = check_phrases(spark, rows, shards=10)
    assert line[2:6] == ("rare pair", 10, 10, 10)


def test_awkward_documents_have_phrases(spark, awkward, empty):
    assert phrases.mine(empty).count() == 0
    got = phrases.mine(awkward)
    want = phrases_by_force([(r["lang"], r["text"]) for r in awkward.select("lang", "text").collect()], phrases.SUPPORT, phrases.TOP)
    assert sorted(tuple(r) for r in got.collect()) == want and want


PAGES = "page_id long, url string, html string, row long, token string, verdict string, probe string"


def tokens_by_force(url):
    host, path = place(url)
    if not host:
        return []
    labels, folders = host.split("."), path.split("/")
    page = url.split("#")[0]
    query = re.sub("=[^&]*", "", page.split("?", 1)[1]) if "?" in page else ""
    last = re.sub("[0-9]+", "0", folders[-1])
    out = [("scheme", url.split("://")[0]), ("tld", labels[-1]), ("host", host)]
    out += [("site", ".".join(labels[-2:]))] * (len(labels) >= 2) + [("sub", labels[0])] * (len(labels) >= 3)
    out += [("dir", f) for f in folders[1:-1][:1]] + [("file", last)] * (len(folders) >= 2 and last != "")
    out += [("query", query)] * (query != "") + [("mark", "#")] * ("#" in url)
    return sorted(f"{k}:{hashlib.md5(v.encode()).hexdigest() if len(v) > url_rules.LONG else v}" for k, v in out)


def place(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda c: c.group().lower(), m[1]), m[2]) if m else ("", "")


def judge_by_force(urls):
    """``(host, path, rule, verdict, mined, confidence)`` of each URL."""
    fixed = []
    for url in urls:
        host, path = place(url)
        fits = [(len(h + s), h + s, v) for h, s, v in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(s)]
        fixed.append(max(fits)[1:] if fits else (None, None))
    own = [tokens_by_force(u) for u in urls]
    sets = [[c for k in (1, 2, 3) for c in itertools.combinations(t, k)] for t in own]
    count, rows = collections.Counter(), collections.Counter()
    for (_, v), subsets in zip(fixed, sets):
        if v:
            count.update((c, v) for c in subsets)
            rows.update(subsets)
    n = sum(v is not None for _, v in fixed)
    least = max(url_rules.LEAST_ROWS, math.ceil(round(n * url_rules.SUPPORT, 9)))
    rules = {(c, v): (h * 1_000_000 // rows[c], h) for (c, v), h in count.items() if h >= least and h * 1_000_000 // rows[c] >= url_rules.CONFIDENCE}
    rules = {
        (c, v): x for (c, v), x in rules.items()
        if not any(rules.get((s, v), (0, 0))[0] >= x[0] for k in range(1, len(c)) for s in itertools.combinations(c, k))
    }
    out = []
    for url, (rule, verdict), subsets in zip(urls, fixed, sets):
        met = [(-x[0], -x[1], len(c), " & ".join(c), v) for c in subsets for v in ("allow", "block") if (x := rules.get((c, v)))]
        best = min(met) if met else None
        out.append((*place(url), rule, verdict or (best[4] if best else "allow"), best and best[3], best and -best[0]))
    return out


def make_urls():
    rng = random.Random(6)
    hosts = ["example.com", "www.example.com", "a.www.example.com", "blog.x.net", "x.net", "y.org", "shop.y.org", "com", "notexample.com", "NET"]
    urls = []
    for i in range(500):
        tail = rng.choice(["", "", "?a=1&b=2", "#top", "?q=x#y", "#a?b=c"])
        urls.append(f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}/{rng.choice(['en', 'es', 'fr', 'de/x'])}/{rng.choice([i, f'{i}.html', ''])}{tail}")
    urls += [None, "", "no scheme", "://", "http://", "http://Example.COM", "http://example.com?x", "x://a://b/c", "HTTP://EXAMPLE.COM/EN/1", "http://example.com/en",
             "http://example.com//en/", "http://xn--é.net/es/ü", "http://net/fr/", "http://.com/en/", "http://a\nb.net/es/\n?c", "http://" + "l" * 300 + ".net/fr/1"]
    return urls + urls[:50]


def test_judgements_equal_brute_force(spark):
    urls = make_urls()
    rows = [(i if i % 9 else None, u, "h", 1, "t", "v", "p") for i, u in enumerate(urls)]
    got = url_rules.judge(spark.createDataFrame(rows, PAGES).repartition(4)).collect()
    want = [(r[0], *w) for r, w in zip(rows, judge_by_force(urls))]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    verdicts = {(r["verdict"], r["rule"] is None, r["mined"] is None) for r in got}
    assert {("block", True, False), ("allow", True, True), ("block", False, False)} <= verdicts


def test_urls_without_labels(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x/1"), (2, None)], "page_id long, url string")
    assert [(r["verdict"], r["mined"]) for r in url_rules.judge(pages).collect()] == [("allow", None)] * 2
    assert url_rules.judge(pages.limit(0)).count() == 0


def test_mined_rules_are_whole_and_pruned(spark):
    rows = [(["a", "b", "c"], "block")] * 20 + [(["a", "d"], "allow")] * 20 + [(["d"], "block")] * 1
    found = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string")).collect()
    got = {(tuple(r["tokens"]), r["verdict"], r["confidence"], r["hits"]) for r in found}
    assert got == {(("b",), "block", 1_000_000, 20), (("c",), "block", 1_000_000, 20), (("d",), "allow", 952_380, 20), (("a", "d"), "allow", 1_000_000, 20)}
    assert all(r["probe"] in r["tokens"] for r in found)


@pytest.mark.parametrize("name", ["op11_centroids", "op12_phrases", "op13_url_rules"])
def test_plans_have_no_cross_join(spark, name):
    from tonegrain.llm.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    if name == "op13_url_rules":
        assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan
