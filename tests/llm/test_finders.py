"""PII, licenses, WARC archives and vectors against brute force."""

from __future__ import annotations

import base64
import hashlib
import random
import re

import numpy as np
import pytest

from tests_llm_helpers import components_by_force, prose
from pyspark.sql import functions as F

from tonegrain.llm import embed_dup, licenses, pii, warc
from tonegrain.llm.common import stage
from tonegrain.llm.queries import QUERIES

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def by_rules(text):
    out = []
    for k, (name, rule) in enumerate(RULES.items()):
        for m in re.finditer(rule, text):
            d = re.sub("[^0-9]", "", m.group())
            if name == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if name == "card":
                v = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
                if not 16 <= len(d) <= 19 or sum(x - 9 if x > 9 else x for x in v) % 10:
                    continue
            if name == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((k, *m.span()))
    return out


def test_base_spans_equal_the_rules():
    rng = random.Random(7)
    parts = ["a.b@c.de", "x@y", "@z.io", "1.2.3.4", "999.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112",
             "+1 (243) 555-5526", "+1", "é😀", " ", "\n", "..", "@", "a@b.c@d.ef", "00000000001.02.3.4", "12345678901234567890", "-", "+", "5"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 9)))
        assert pii.base_spans(text) == by_rules(text), text


def test_pii_query_counts_spans_by_kind(spark, tmp_path):
    rng = random.Random(11)
    parts = ["a.b@c.de", "1.2.3.4", "999.1.1.1", "4111 1111 1111 1111", "+1 (243) 555-5526", "a@b.c@d.ef", "é😀", " ", " ", "\n", "w"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    texts = [None, "", "+1 (243) 555-5526", "1.2.3.4 5.6.7.8", *texts]
    rows = [*enumerate(texts), (7, texts[7]), (None, "a@b.cd +1 (243) 555-5526")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    by_id = {r["doc_id"]: r for r in QUERIES["op2_pii"](spark, str(tmp_path)).collect()}
    assert len(by_id) == len(texts) + 1
    for doc_id, text in rows:
        r, spans = by_id[doc_id], by_rules(text or "")
        assert [r[f"n_{k}"] for k in RULES] == [sum(s[0] == i for s in spans) for i in range(4)], text
        listed = ",".join(f"{list(RULES)[k]}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), text


def test_contexts_of_seeds_find_other_identifiers(spark, awkward, empty):
    rng, rows = random.Random(1), []
    for i in range(40):
        rows.append((i, f"{prose(i, 20)} reach me at user{i}@mail.example.com today {prose(i + 99, 5)}"))
    rows += [(100, prose(3, 9) + " reach me at user77(at)mail today w1"), (101, prose(4, 9) + " code x99y w2 " + str(rng.random()))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in pii.find(docs).collect()}
    assert all(len(got[i]["spans"]) == 1 and not got[i]["more"] for i in range(40))
    (found,) = got[100]["more"]
    assert rows[40][1][found["start"] : found["end"]] == "user77(at)mail" and found["kind"] == 0
    assert not got[101]["more"] and not got[101]["spans"]
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert " at <EMAIL> today" in clean[100] and " at <EMAIL> today" in clean[0] and clean[101] == rows[41][1]
    assert pii.find(awkward).count() == awkward.count() and pii.redact(awkward).columns == awkward.columns
    assert pii.find(empty).count() == 0 and pii.redact(empty).count() == 0


def test_found_instances_induce_patterns_of_their_own(spark):
    # Codes stand in the context of e-mails, and in one without any; others stand only there.
    rows = [(i, f"{prose(i, 9)} reach me at user{i}@mail.example.com today {prose(i + 99, 5)}") for i in range(60)]
    rows += [(100 + i, f"{prose(i, 9)} reach me at c{i}de today w1 {prose(i, 9)}") for i in range(14)]
    rows += [(200 + i, f"{prose(i, 9)} my own login c{i}de works here {prose(i, 9)}") for i in range(14)]
    rows += [(300, f"{prose(1, 9)} my own login k9xyz works here {prose(2, 9)}"), (301, f"{prose(1, 9)} plain word k8xyz in w3 {prose(2, 9)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    text = dict(rows)
    got = {r["doc_id"]: [text[r["doc_id"]][s["start"] : s["end"]] for s in r["more"]] for r in pii.find(docs).collect()}
    assert got[300] == ["k9xyz"] and got[301] == [] and all(got[200 + i] == [f"c{i}de"] for i in range(14))
    first, _ = pii.trusted(pii.extract(docs), rounds=1)
    third, _ = pii.trusted(pii.extract(docs))
    assert third.count() > first.count()


def test_license_phrases_equal_brute_force_and_notices_are_found(spark, awkward, empty):
    long_notice = licenses.NOTICES[6][0]
    words = long_notice.split()
    texts = {
        1: "All Rights\nreserved, all rights reserved! cc-by x CC BY", 2: "the general public license", 3: prose(1, 3000) + " cc by " + prose(2, 2000),
        4: "Released under the MIT License.", 5: " ".join(w for i, w in enumerate(words) if i not in (7, 15)), 6: "all rights are reserved", 7: None,
        8: "rights reserved general license permission is hereby", 9: " ".join([*["w"] * 1023, "all", "rights", "reserved"]), 10: "cc by " * 1500,
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    for r in licenses.scan(docs).collect():
        own = licenses.split_words((texts[r["doc_id"]] or "").encode())
        found = sorted(
            (i, label) for phrase, label in licenses.PHRASES for i in range(len(own)) if own[i : i + len(phrase.split())] == phrase.encode().split()
        )
        assert (r["n_words"], r["n_base"]) == (len(own), len(found))
        assert (r["first_word"], r["last_word"]) == ((found[0][0], found[-1][0]) if found else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in found}))
        assert set(r["base_labels"].split(",")) <= {*r["labels"].split(","), ""}
        if r["doc_id"] in (4, 5):
            assert r["labels"] == "mit" and r["score"] >= 0.5
        if r["doc_id"] in (6, 7, 8):
            assert r["labels"] == "" and r["score"] == 0
    assert licenses.scan(awkward).count() == awkward.count() and licenses.scan(empty).count() == 0


PAGES = "page_id long, url string, html string, kind string, value binary, size int"


def test_archives_round_trip_with_magic_inside_payloads(spark, tmp_path):
    trap = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"
    htmls = ["same", "same", None, "", trap, trap + "tail", "WARC/1.1\r\n", "é" * 5000, "end\r\n\r\n", "same"] + [prose(i, 200) for i in range(60)]
    rows = [(i if i != 9 else None, f"http://x/{i}", h, "k", None, 1) for i, h in enumerate(htmls)]
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    path = str(tmp_path / "warc")
    warc.write(pages, path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")  # many ranges per file
    try:
        back = stage(warc.read(spark, path), "back").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {r["page_id"]: r for r in back}
    assert len(back) == len(rows) and all(r["verified"] for r in back)
    best = {}
    for i, _, h, *_ in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    for i, _, h, *_ in rows:
        data, r = (h or "").encode(), got[i]
        assert r["payload_bytes"] == len(data)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        again = best[h or ""] != i
        assert (r["record_type"], r["refers_to"]) == (("revisit", best[h or ""]) if again else ("response", None))
        assert again or bytes(r["payload"]) == data
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def vectors(rng, n):
    base = rng.normal(size=(n // 8, 32))
    x = base[rng.integers(0, len(base), n)] + rng.normal(size=(n, 32)) * rng.choice([0.01, 0.1, 0.5], (n, 1))
    return x


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embed_dup, "SHARD", 300)  # several shards
    rng = np.random.default_rng(3)
    x = vectors(rng, 900)
    x[40:60] = x[7]
    rows = [(i, [float(c) for c in v], int(i % 2)) for i, v in enumerate(x)]
    rows += [(2000, None, 1), (2001, [0.0] * 32, 1), (2002, [float("nan")] * 32, 1), (2003, [None] * 32, 1), (2004, rows[7][1], None), (2005, [1.0, 2.0], 0), (2006, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r["vec_id"]: r for r in embed_dup.find(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos, label = u @ u.T, np.arange(len(x)) % 2
    link = (cos >= embed_dup.LINK) & (label[:, None] == label) & ~np.eye(len(x), dtype=bool)
    true = link.sum(1)
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (found <= true).all() and found.sum() >= 0.99 * true.sum()
    want = components_by_force(list(range(len(x))), lambda a, b: link[a, b])
    assert np.mean([got[i]["component_id"] == want[i] for i in want]) > 0.99
    assert got[0]["audit_recall"] >= 0.9
    apart = link & (np.abs(x[:, None] - x).max(2) > 0)
    assert got[0]["audit_links"] == apart[::20].sum() > 0
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in range(2000, 2007))
    assert embed_dup.find(df.limit(0)).count() == 0


def test_links_of_a_group_larger_than_a_shard_are_all_counted(spark, monkeypatch):
    monkeypatch.setattr(embed_dup, "SHARD", 100)
    rng = np.random.default_rng(8)
    # One dense group, a looser one that is linked in part, and rows apart; row 0 has a copy.
    x = np.concatenate([rng.normal(size=32) + rng.normal(size=(700, 32)) * 0.05, rng.normal(size=32) + rng.normal(size=(300, 32)) * 0.14, rng.normal(size=(100, 32))])
    x = np.concatenate([x, x[:1]])
    df = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embed_dup.find(df.repartition(4)).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= embed_dup.LINK) & ~np.eye(len(x), dtype=bool)
    true, found = link.sum(1), np.array([got[i]["n_links"] for i in range(len(x))])
    assert true.max() >= 700 and 0 < link[700:1000].mean(1).max() < 0.3
    assert (found[:700] == true[:700]).all() and (found <= true).all() and found.sum() >= 0.999 * true.sum()
    want = components_by_force(list(range(len(x))), lambda a, b: link[a, b])
    assert [got[i]["component_id"] for i in range(700)] == [want[i] for i in range(700)]


def test_below_the_floor_every_row_meets_all_others(spark, monkeypatch):
    monkeypatch.setattr(embed_dup, "SHARD", 80)
    monkeypatch.setattr(embed_dup, "VISITORS", 50)
    monkeypatch.setattr(embed_dup, "FLOOR", 2.0)  # no search is good enough
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(size=32) + rng.normal(size=(150, 32)) * 0.12, vectors(rng, 250)])
    x[200:210] = x[3]
    label = np.where(np.arange(len(x)) % 3 == 0, 1, 2)
    rows = [(i, [float(c) for c in v], int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))]
    got = {r["vec_id"]: r for r in embed_dup.find(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= embed_dup.LINK) & (label[:, None] == label) & ~np.eye(len(x), dtype=bool)
    assert [got[i]["n_links"] for i in range(len(x))] == link.sum(1).tolist()
    want = components_by_force(list(range(len(x))), lambda a, b: link[a, b])
    assert {i: got[i]["component_id"] for i in want} == want
    assert got[0]["audit_recall"] == 1.0


def test_audit_sees_links_that_were_missed(spark):
    x = np.random.default_rng(4).normal(size=16) + np.zeros((60, 16))
    x += np.random.default_rng(5).normal(size=x.shape) * 0.01
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x)]
    placed, classes = embed_dup.classes_of(spark.createDataFrame([*rows, (None, None, None)], "vec_id long, embedding array<double>, label int"))
    none = spark.createDataFrame([], "rep long, n long")
    assert embed_dup.audit(placed, classes, none) == (0.0, 3 * 59)
    half = classes.select("rep", F.lit(30).cast("long").alias("n"))
    assert embed_dup.audit(placed, classes, half) == (30 / 59, 3 * 59)


@pytest.mark.parametrize("noise", [0.0, 1e-9])
def test_scaled_copies_beyond_a_shard_end_and_link(spark, monkeypatch, noise):
    monkeypatch.setattr(embed_dup, "SHARD", 60)
    rng = np.random.default_rng(4)
    x = np.outer(np.arange(1, 301), np.eye(8)[0]) + rng.normal(size=(300, 8)) * noise
    x = np.concatenate([x, rng.normal(size=(20, 8))])
    schema = "vec_id long, embedding array<double>, label int, rep long, cluster long, home boolean, size long"
    rows = [(None if i == 5 else i, [float(c) for c in v], 3, 1, 2, True, 9) for i, v in enumerate(x)]
    got = embed_dup.find(spark.createDataFrame(rows, schema).repartition(4)).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = ((u @ u.T >= embed_dup.LINK) & ~np.eye(len(x), dtype=bool)).sum(1)
    assert len(got) == 320 and {r["vec_id"]: r["n_links"] for r in got} == {None if i == 5 else i: n for i, n in enumerate(true)}
    assert all(r["component_id"] == 0 for r in got if r["vec_id"] is None or r["vec_id"] < 300)


def test_a_split_that_keeps_all_rows_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(embed_dup, "SHARD", 60)
    monkeypatch.setattr(embed_dup, "STUCK", -1.0)  # every second split counts as one
    rng = np.random.default_rng(5)
    x = vectors(rng, 400)
    got = embed_dup.find(spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = ((u @ u.T >= embed_dup.LINK) & ~np.eye(len(x), dtype=bool)).sum(1)
    found = np.array([n for _, n in sorted((r["vec_id"], r["n_links"]) for r in got)])
    assert (found <= true).all() and found.sum() >= 0.95 * true.sum()


def test_robust_prune_drops_covered_neighbours():
    x = np.array([[1, 0], [0.999, 0.0447], [0.995, 0.0999], [0, 1.0]], np.float32)
    (near,) = embed_dup.robust_prune(x, np.array([0]), np.array([[1, 2, 3, 0]]), degree=3)
    assert near.tolist() == [1, 3] or near.tolist() == [1]


@pytest.mark.parametrize("stages", [5])
def test_pipeline_stages_do_their_work(spark, stages, tmp_path):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.limit(0).union(docs)
    assert [n for n, _ in p.STAGES] == ["toxicity", "near_dup", "pii", "mixing", "packing"] and len(p.STAGES) == stages
    kept = docs
    for name, run in p.STAGES[:-1]:
        out = stage(run(spark, kept, sf), f"test-{name}")
        assert out.columns == docs.columns
        if name in ("toxicity", "near_dup"):
            assert out.subtract(kept).count() == 0 and 0 < out.count() <= kept.count()
        if name == "pii":
            assert out.count() == kept.count()
            assert not any(pii.base_spans(r["text"] or "") for r in out.collect())
        kept = out
    pieces = p.STAGES[-1][1](spark, kept, sf)
    assert pieces.filter("start = 0").count() == kept.count()
    assert p.STAGES[0][1](spark, docs.limit(0), sf).count() == 0
