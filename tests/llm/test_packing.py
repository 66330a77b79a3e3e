from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from kinvote.llm import packing, tokens
from pyspark.sql import functions as F

ITEMS = "item long, n_tokens long, source string, content long, bin_id string"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 100), st.sampled_from("ab"), st.one_of(st.none(), st.integers(0, 5))), max_size=60))
def test_best_fit_keeps_its_rules(items):
    bins = packing.pack([x[0] for x in items], [x[1] for x in items], [x[2] for x in items], 100, 1.0)
    used, held = Counter(), defaultdict(Counter)
    for (size, _, cluster), b in zip(items, bins):
        used[b] += size
        if cluster is not None:
            held[b][cluster] += 1
    assert all(u <= 100 for u in used.values())
    least = max(1, -(-sum(x[0] for x in items) // 100))
    counts = Counter(x[2] for x in items if x[2] is not None)
    assert all(n <= max(1, -(-counts[c] // least)) for own in held.values() for c, n in own.items())


def test_tightest_compatible_bin():
    assert packing.pack([60, 50, 40, 30], ["a"] * 4, [None] * 4, 100, 1.0) == [0, 1, 0, 1]
    assert packing.pack([60, 40, 40], ["a"] * 3, [1, 1, None], 100, 1.0) == [0, 1, 0]
    assert len(set(packing.pack([50, 30, 20] * 2, ["a", "a", "b"] * 2, [None] * 6, 100, 0.5))) <= 3


def test_sources_share_bins():
    bins = packing.pack([10] * 100, ["a", "b"] * 50, [None] * 100, 100, 0.75)
    assert len(set(bins)) == 10
    held = defaultdict(Counter)
    for i, b in enumerate(bins):
        held[b]["ab"[i % 2]] += 10
    assert all(n <= 75 for own in held.values() for n in own.values())


@pytest.mark.parametrize("shard_tokens", [10**9, 2000])
def test_containers(spark, shard_tokens):
    r = random.Random(1)
    data = [(i, r.choice([0, None, 5, 40, 99, 100, 101, 350, r.randrange(1, 100)]), r.choice(["a", "b", None]), r.choice([None, i, i % 9]), "clash") for i in range(400)]
    data += [(1000, 5, "a", 3, "x"), (1001, 230, "a", 3, "x"), (None, 150, "b", None, "x")] * 3
    got = packing.fill_containers(spark.createDataFrame(data, ITEMS), 100, shard_tokens=shard_tokens).collect()
    want = Counter()
    for i, n, *_ in data:
        want[i] += n or 0
    sizes, used = Counter(), Counter()
    for x in got:
        sizes[x["item"]] += x["n_tokens"]
        if x["bin_id"] is None:
            assert x["n_tokens"] == 0
        else:
            used[x["bin_id"]] += x["n_tokens"]
            assert x["start"] == 100 * x["piece"]
    assert sizes == want and set(sizes) == set(want)
    assert all(x["used"] == used[x["bin_id"]] <= 100 for x in got if x["bin_id"])
    pieces = Counter(x["item"] for x in got if x["item"] is not None and x["item"] < 1000)
    assert all(pieces[i] == max(1, -(-(n or 0) // 100)) for i, n, *_ in data if i is not None and i < 1000)
    assert len(used) <= 1.15 * sum(want.values()) / 100 + 3


def test_one_source_and_one_cluster_waste_nothing(spark):
    data = [(i, 10, "only", 7, "x") for i in range(500)]
    got = packing.fill_containers(spark.createDataFrame(data, ITEMS), 100).collect()
    assert len({x["bin_id"] for x in got}) == 50


def test_no_items(spark):
    assert packing.fill_containers(spark.createDataFrame([], ITEMS), 100).count() == 0


def test_documents(spark):
    long = "word " * 9000
    data = [(1, "a", "One text."), (2, "A", " one  TEXT."), (3, None, None), (4, "b", ""), (5, "b", long), (6, "b", "x" * 300_000)]
    docs = spark.createDataFrame(data, "doc_id long, source string, text string").withColumnRenamed("source", "source")
    got = packing.pack_documents(docs).collect()
    total = Counter()
    for x in got:
        total[x["doc_id"]] += x["n_tokens"]
    encode = tokens.encoder(tokens.vocabulary_path(tokens.VOCABULARY)).encode_ordinary
    assert total == {i: len(encode(t)) if t else 0 for i, _, t in data}
    assert {x["doc_id"] for x in packing.oversized(docs).collect()} == {5, 6}
    measured = {r["doc_id"]: r["content"] for r in tokens.measured(docs.withColumnRenamed("source", "Content")).collect()}
    assert measured[1] == measured[2] != measured[5] and measured[3] is None and measured[4] is None


def test_loose_containers_are_packed_again_within_bounds(spark, monkeypatch):
    """All parts of both passes hold few items, and hardly more containers are used."""
    r = random.Random(7)
    data = [(i, r.randrange(1, 60), "ab"[i % 2], None, "x") for i in range(3000)]
    items = spark.createDataFrame(data, ITEMS)
    monkeypatch.setattr(packing, "SHARD_ITEMS", 300)
    got = packing.fill_containers(items, 100).collect()
    shards = Counter(x["bin_id"].split("-")[0] for x in got)
    assert len(shards) >= 11 and max(shards.values()) < 450
    assert len({x["bin_id"] for x in got}) <= 1.03 * sum(d[1] for d in data) / 100


def test_names_are_the_same_in_every_run(spark):
    data = [(i, 250 + i % 3, "a", i, "x") for i in range(50)] + [(7, 250, "a", 7, "x")] * 3
    items = spark.createDataFrame(data, ITEMS)
    runs = [sorted((x["bin_id"], x["item"], x["piece"]) for x in packing.fill_containers(items.repartition(n), 100).where("n_tokens = 100").collect()) for n in (1, 5)]
    assert runs[0] == runs[1] and len({b for b, *_ in runs[0]}) == len(runs[0]) == 2 * len(data)


def test_container_report(spark):
    data = [(1, 30, "a", 5, "x"), (2, 30, "a", 5, "x"), (3, 250, "b", 6, "x"), (4, 0, "b", None, "x"), (5, 60, "a", 7, "x")]
    items = spark.createDataFrame(data, ITEMS)
    got = packing.container_report(items, packing.fill_containers(items, 100), 100).first().asDict()
    assert {k: got[k] for k in ("overfull", "misstated", "lost", "cut_needlessly", "with_copies")} == dict.fromkeys(("overfull", "misstated", "lost", "cut_needlessly", "with_copies"), 0)
    assert got["least"] == 4 and got["containers"] >= 4
    bad = spark.createDataFrame([("x", 1, 0, 30, 60), ("x", 2, 0, 30, 60), ("y", 3, 0, 120, 99), ("z", 5, 0, 30, 30), ("z2", 5, 1, 30, 30)], "bin_id string, item long, piece int, n_tokens long, used long")
    said = packing.container_report(items, bad, 100).first().asDict()
    assert {k: said[k] for k in ("overfull", "misstated", "lost", "cut_needlessly", "with_copies")} == {"overfull": 1, "misstated": 1, "lost": 2, "cut_needlessly": 1, "with_copies": 1}


def test_few_partitions_are_spread(spark):
    one = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).coalesce(1)
    assert tokens.spread(one, "doc_id").select(F.spark_partition_id()).distinct().count() == spark.sparkContext.defaultParallelism
    many = one.repartition(9)
    assert tokens.spread(many, "doc_id") is many
