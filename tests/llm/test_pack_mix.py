"""Packing and mixing: exact round trips and sums."""

from __future__ import annotations

import collections

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests_llm_helpers import prose
from tonegrain.llm import mixing, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_pieces_put_together_are_the_tokenizer_s_ids(spark, awkward, empty, tmp_path):
    texts = ["Hello, WORLD! it's <|endoftext|> x", "naïve Ünï “quotes” — 12345 ９", " ", None, prose(3, 9000), "can't stop now", "ÅB̈ Σίσυφος İ"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    own = Tokenizer.from_file(PATH)
    own.encode_special_tokens = True
    rows = packing.pack(docs, PATH).collect()
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    for i, text in enumerate(texts):
        want = [*own.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
        pieces = sorted(by_doc[i], key=lambda r: r["start"])
        assert np.frombuffer(b"".join(p["ids"] for p in pieces), "<u4").tolist() == want
        assert all(p["length"] & (p["length"] - 1) == 0 and p["offset"] == 0 and p["doc_tokens"] == len(want) for p in pieces)
        assert [p["start"] for p in pieces] == np.cumsum([0] + [p["length"] for p in pieces])[:-1].tolist()
        assert sum(p["length"] < packing.MAX_LEN for p in pieces) <= 12
    assert packing.pack(awkward, PATH).filter("start = 0").count() == awkward.count()
    assert packing.pack(empty, PATH).count() == 0
    packing.write_buckets(packing.pack(docs, PATH), str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).filter("bucket <> length").count() == 0


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Words wanted of each source, one resharing after the other."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while free and left > 0:
        whole = sum(weights[i % len(weights)] for i in free)
        parts = {i: left * weights[i % len(weights)] / whole for i in free}
        full = {i for i in free if parts[i] > most * sizes[i]}
        for i in full or free:
            out[i] = most * sizes[i] if full else parts[i]
        if not full:
            break
        left -= sum(out[i] for i in full)
        free -= full
    return out


@pytest.mark.parametrize("sizes", [[10, 1000, 1000, 0], [], [0, 0], [7], [3 ** (i % 9) for i in range(40)]])
def test_targets_are_shared_again_until_none_is_above(spark, sizes):
    names = [f"s{i:03d}" for i in range(len(sizes))]
    if names:
        names[-1] = None  # null comes last
    sources = spark.createDataFrame([(s, w, 1) for s, w in zip(names, sizes)], "source string, words long, rows long")
    got = mixing.source_lines(sources.repartition(3)).orderBy("_mix_rank").collect()
    assert [r["_mix_name"] for r in got] == names and [r["_mix_rank"] for r in got] == list(range(len(sizes)))
    assert [r["_mix_target"] for r in got] == pytest.approx(plain_targets(sizes), rel=1e-12)


def test_sources_are_ranked_by_code_point(spark):
    names = ["a", "B", "é", "\U0001f600", "\uffee", "", None]
    sources = spark.createDataFrame([(s, 5, 1) for s in names], "source string, words long, rows long")
    got = [r["_mix_name"] for r in mixing.source_lines(sources).orderBy("_mix_rank").collect()]
    assert got == [*sorted(n for n in names if n is not None), None]


def taken_of(docs):
    rows = mixing.taken(docs).collect()
    words, wanted = collections.Counter(), {}
    for r in rows:
        assert 0 <= r["_mix_copies"] <= 2 and r["_mix_copies"] == r["_mix_take"]
        words[r["_mix_rank"]] += r["_mix_size"] * r["_mix_copies"]
        wanted[r["_mix_rank"]] = r["_mix_target"]
    return sorted((str(r["doc_id"]), r["_mix_size"], r["_mix_copies"]) for r in rows), words, wanted


def test_repeated_rows_do_not_keep_a_source_from_its_target(spark, monkeypatch):
    rows = [(77, "a b c d e", "s0", i) for i in range(600)] + [(i, "v w x y z", "s0", i) for i in range(1000, 1400)]
    rows += [(i, "k l m", f"s{1 + i % 3}", 0) for i in range(2000, 3500)] + [(None, None, None, 1)] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _slice int").repartition(5)
    got, words, wanted = taken_of(docs)
    assert len(got) == len(rows)
    for rank, want in wanted.items():
        assert abs(words[rank] - want) <= 5, (rank, words[rank], want)
    assert taken_of(docs.repartition(3))[0] == got
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.groupBy().agg({"*": "count"}).first()[0] == sum(c for _, _, c in got)
    # In blocks that hold many rows each, too.
    monkeypatch.setattr(mixing, "BLOCKS", 64)
    got, words, wanted = taken_of(docs)
    assert len(got) == len(rows)
    for rank, want in wanted.items():
        assert abs(words[rank] - want) <= 5 * 1000 / 64, (rank, words[rank], want)


def test_many_sources_take_the_same_rows(spark, monkeypatch):
    rows = [(i, prose(i, 5 + i % 40), None if i % 31 == 0 else f"s{i % 37 if i % 3 else 0}") for i in range(600)]
    rows += [(9, "a b c", "s0")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = taken_of(docs)
    monkeypatch.setattr(mixing, "NARROW", 4)  # most lines are joined by shuffle
    monkeypatch.setattr(mixing, "BUNDLES", 5)  # sources share bundles
    assert taken_of(docs) == got


def test_bundles_split_what_they_were_given():
    quotas, sizes = np.array([40, 7, 0, 13]), np.array([10, 20, 0, 30])
    got = mixing.split_quotas(quotas, 4, [1, 2], sizes)
    assert (got.sum(axis=0) == quotas).all() and (got.sum(axis=1) == sizes).all()
    large = np.array([3_000_000_000, 5, 1_234_567_891])
    got = mixing.split_quotas(large, 8)
    assert (got.sum(axis=0) == large).all() and (got >= 0).all()


def test_splitting_tree_keeps_quotas():
    quotas = np.array([1000, 3, 0, 77])
    got = mixing.split_quotas(quotas, 13)
    assert got.shape == (13, 4) and (got.sum(axis=0) == quotas).all() and (got >= 0).all()
    assert got.sum(axis=1).max() - got.sum(axis=1).min() <= 13
    assert (got == mixing.split_quotas(quotas, 13)).all()


def test_mix_takes_words_near_targets(spark, awkward, empty):
    rows = [(i, prose(i, 5 + i % 90), f"s{i % 5 if i % 3 else 0}") for i in range(900)] + [(5000, None, None), (5001, "a b c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    planned, _ = mixing.plan(docs)
    got = {r["doc_id"]: r for r in planned.collect()}
    sizes = {i: len((t or "").split()) for i, t, _ in rows}
    assert {i: r["_mix_size"] for i, r in got.items()} == sizes
    taken = collections.Counter()
    for r in got.values():
        assert r["_mix_take"] * r["_mix_size"] <= 2 * r["_mix_size"]
        taken[r["source"]] += r["_mix_take"] * r["_mix_size"]
    want = {r["source"]: r["_mix_target"] for r in got.values()}
    assert all(abs(taken[s] - t) <= max(10, 0.01 * t) for s, t in want.items())
    mixed = mixing.mix(docs)
    copies = collections.Counter(r["doc_id"] for r in mixed.collect())
    assert copies == {i: r["_mix_take"] for i, r in got.items() if r["_mix_take"]}
    assert {r["doc_id"]: r["_mix_copies"] for r in mixing.taken(docs).collect()} == {i: r["_mix_take"] for i, r in got.items()}
    shards = mixing.place(*mixing.plan(docs), 8).select("_mix_rank", "_mix_place", "_mix_shard").distinct().collect()
    sizes_of = collections.Counter(r["_mix_shard"] for r in shards)
    assert set(sizes_of) == set(range(8)) and max(sizes_of.values()) - min(sizes_of.values()) <= 8
    assert len({(r["_mix_rank"], r["_mix_place"]) for r in shards}) == len(shards)  # each place in one shard
    again, _ = mixing.plan(docs.repartition(7))
    assert {r["doc_id"]: r["_mix_take"] for r in again.collect()} == {i: r["_mix_take"] for i, r in got.items()}
    assert mixing.plan(awkward)[0].count() == awkward.count() and mixing.mix(awkward).columns == awkward.columns
    assert mixing.taken(awkward).count() == awkward.count() and mixing.taken(empty).count() == 0
    assert mixing.plan(empty)[0].count() == 0 and mixing.mix(empty).count() == 0
