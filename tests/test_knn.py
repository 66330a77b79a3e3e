from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest
from kinvote.operators import knn
from pyspark.sql import functions as F

Q, R = "query_pos long, protein_accession string, embedding array<float>", "ref_pos long, ref_accession string, embedding array<float>"


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(0)
    q, r = rng.normal(size=(6, 8)).astype("f4"), rng.normal(size=(40, 8)).astype("f4")
    r[30:35] = r[:5]
    names = [f"R{i:03d}" for i in range(30)] + [f"R{i:03d}" for i in range(5)] + [f"S{i}" for i in range(5)]
    queries = spark.createDataFrame([(i, f"Q{i}", v.tolist()) for i, v in enumerate(q)], Q)
    refs = spark.createDataFrame([(i, n, v.tolist()) for i, (n, v) in enumerate(zip(names, r))], R)
    return queries.cache(), refs.cache(), q.astype("f8"), r.astype("f8"), names


def hits(df):
    out = {}
    for x in sorted(df.collect(), key=lambda x: (x["query_pos"], x["k_position"])):
        out.setdefault(x["query_pos"], []).append((x["ref_pos"], round(x["distance"], 9)))
    return out


def brute(q, r, k, metric, threshold=None):
    d = np.round(knn.matrix_distance(q, r, metric), 12)
    out = {}
    for i, row in enumerate(d):
        own = sorted((x, j) for j, x in enumerate(row) if threshold is None or x <= threshold)[:k]
        if own:
            out[i] = [(j, round(x, 9)) for x, j in own]
    return out


@pytest.mark.parametrize("strategy", ["block", "jvm"])
@pytest.mark.parametrize("metric", knn.METRICS)
def test_exact_strategies(sides, strategy, metric):
    queries, refs, q, r, _ = sides
    assert hits(knn.knn_join(queries, refs, 7, metric, strategy=strategy)) == brute(q, r, 7, metric)


@pytest.mark.parametrize("k", [0, 40, 100])
def test_k_beyond_both_ends(sides, k):
    queries, refs, q, r, _ = sides
    assert hits(knn.knn_join(queries, refs, k, strategy="block")) == (brute(q, r, k, "cosine") if k else {})


def test_threshold_is_inclusive(sides):
    queries, refs, q, r, _ = sides
    edge = brute(q, r, 3, "l2")[0][2][1]
    got = hits(knn.knn_join(queries, refs, 5, "l2", distance_threshold=edge + 1e-9, strategy="block"))
    assert got == brute(q, r, 5, "l2", edge + 1e-9)
    assert len(got[0]) == 3


@pytest.mark.parametrize("strategy", ["block", "jvm"])
def test_dedupe_takes_the_closest_row_of_an_accession(sides, strategy):
    queries, refs, q, r, names = sides
    d = np.round(knn.matrix_distance(q, r, "cosine"), 12)
    for i, own in hits(knn.knn_join(queries, refs, 10, strategy=strategy, dedupe=True)).items():
        best = {}
        for x, j in sorted((x, j) for j, x in enumerate(d[i])):
            best.setdefault(names[j], (j, round(x, 9)))
        assert own == list(best.values())[:10]


def test_approximate_strategies_give_true_distances(sides):
    queries, refs, q, r, _ = sides
    d = knn.matrix_distance(q, r, "cosine")
    assert hits(knn.knn_join(queries, refs, 5, strategy="ivf", nlist=4, nprobe=4)) == brute(q, r, 5, "cosine")
    for strategy in ("ivf", "lsh"):
        got = hits(knn.knn_join(queries, refs, 5, strategy=strategy, nlist=8, nprobe=2))
        assert got and all(abs(d[i, j] - x) < 1e-6 for i, own in got.items() for j, x in own)


def test_pre_normalized(sides):
    queries, refs, q, r, _ = sides
    unit = refs.withColumn("n", F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))).withColumn("embedding", F.transform("embedding", lambda x: x / F.col("n")))
    for strategy in ("block", "jvm"):
        fast, slow = hits(knn.knn_join(queries, unit, 5, pre_normalized=True, strategy=strategy)), brute(q, r, 5, "cosine")
        assert {i: [j for j, _ in v] for i, v in fast.items()} == {i: [j for j, _ in v] for i, v in slow.items()}


def test_unusable_vectors_and_empty_sides(spark, sides):
    queries, refs, *_ = sides
    bad = spark.createDataFrame([(90, "N", None), (91, "N", [1.0]), (92, "N", [float("nan")] * 8), (93, "Z", [0.0] * 8)], R)
    for strategy in ("block", "jvm", "ivf", "lsh"):
        got = knn.knn_join(queries, refs.unionByName(bad), 100, strategy=strategy, dim=8, nlist=2, nprobe=2).collect()
        assert not {90, 91, 92} & {x["ref_pos"] for x in got}
        assert all(x["distance"] == pytest.approx(1) for x in got if x["ref_pos"] == 93)
        assert knn.knn_join(queries.limit(0), refs, 5, strategy=strategy).count() == 0
        assert knn.knn_join(queries, refs.limit(0), 5, strategy=strategy).count() == 0


def test_long_vectors_keep_their_order(spark):
    """Squared distances far below the squared lengths are the same whatever the strategy."""
    rng = np.random.default_rng(8)
    r = 8000 / np.sqrt(8) + 1e-4 * rng.normal(size=(60, 8))
    refs = spark.createDataFrame([(i, f"R{i}", v.tolist()) for i, v in enumerate(r)], R.replace("float", "double"))
    queries = spark.createDataFrame([(0, "Q", (r[0] + 1e-5).tolist())], Q.replace("float", "double"))
    want = sorted((round(float(((r[0] + 1e-5 - v) ** 2).sum()), 12), i) for i, v in enumerate(r))[:5]
    for strategy in ("block", "jvm", "ivf"):
        got = knn.knn_join(queries, refs, 5, "l2", strategy=strategy, nlist=2, nprobe=2).orderBy("k_position").collect()
        assert [(x["distance"], x["ref_pos"]) for x in got] == want


def test_kmeans_finds_separate_heaps():
    rng = np.random.default_rng(2)
    x = np.concatenate([c + 0.01 * rng.normal(size=(50, 4)) for c in 10 * np.eye(4)])
    centres = knn.kmeans(x, 8, 1)
    assert knn.matrix_distance(x, centres, "l2").min(1).max() < 0.01


def test_bad_arguments(sides):
    queries, refs, *_ = sides
    with pytest.raises(ValueError, match="metric"):
        knn.knn_join(queries, refs, 5, "dot")
    with pytest.raises(ValueError, match="strategy"):
        knn.knn_join(queries, refs, 5, strategy="tree")
    with pytest.raises(ValueError, match="negative"):
        knn.knn_join(queries, refs, -1)


def test_many_blocks(sides, monkeypatch):
    queries, refs, q, r, _ = sides
    monkeypatch.setattr(knn, "QUERY_BLOCK", 2)
    monkeypatch.setattr(knn, "REF_BLOCK", 7)
    assert hits(knn.knn_join(queries, refs, 4, strategy="block")) == brute(q, r, 4, "cosine")


def test_the_dimension_is_that_of_most_references(spark, sides):
    queries, refs, q, r, _ = sides
    short = spark.createDataFrame([(100 + i, f"N{i}", [1.0, 2.0]) for i in range(3)], R)
    for strategy in ("block", "jvm"):
        assert hits(knn.knn_join(queries, short.unionByName(refs), 5, strategy=strategy)) == brute(q, r, 5, "cosine")
    assert knn.usable(short.unionByName(refs)).count() == len(r)


def worker_mb():
    """The most memory that any Python worker has had, in MB."""
    most = 0
    for p in Path("/proc").glob("[0-9]*"):
        try:
            if b"pyspark.daemon" in (p / "cmdline").read_bytes():
                most = max([most, *(int(x.split()[1]) for x in (p / "status").read_text().splitlines() if x.startswith("VmHWM"))])
        except OSError:
            pass
    return most // 1024


@pytest.fixture(scope="module")
def large_sides(spark):
    """So many pairs that a worker must not hold those of a block at once."""
    vector = F.array(*[F.rand(i).cast("float") for i in range(4)]).alias("embedding")
    queries = spark.range(0, 4096, 1, 1).select(F.col("id").alias("query_pos"), F.concat(F.lit("Q"), "id").alias("protein_accession"), vector)
    refs = spark.range(5000, 5000 + 16384, 1, 1).select(F.col("id").alias("ref_pos"), F.concat(F.lit("R"), F.col("id") % 9000).alias("ref_accession"), vector)
    return queries.cache(), refs.cache()


def columns(df, pos):
    got = df.orderBy(pos).toPandas()
    return got[pos].to_numpy(), np.array(got["embedding"].tolist(), "f8")


def whole_matrix(large_sides, metric):
    queries, refs = large_sides
    before = worker_mb()
    d = knn.distance_matrix(queries, refs, metric, 4)
    got = d.where("query_pos % 1000 = 7").toPandas().sort_values(["query_pos", "ref_pos"])
    (qp, q), (rp, r) = columns(queries, "query_pos"), columns(refs, "ref_pos")
    some = qp % 1000 == 7
    assert got["query_pos"].tolist() == np.repeat(qp[some], len(rp)).tolist() and got["ref_pos"].tolist() == np.tile(rp, some.sum()).tolist()
    assert np.allclose(got["distance"], knn.matrix_distance(q[some], r, metric).ravel(), atol=1e-11)
    assert d.count() == 4096 * 16384
    assert worker_mb() < max(before, 500)


def test_l2_matrix_is_given_out_in_slabs(large_sides):
    whole_matrix(large_sides, "l2")


def test_dedupe_works_in_slabs(large_sides):
    queries, refs = large_sides
    before = worker_mb()
    got = knn.knn_join(queries, refs, 5, strategy="block", dedupe=True, dim=4).toPandas().sort_values(["query_pos", "k_position"])
    (qp, q), (rp, r) = columns(queries, "query_pos"), columns(refs, "ref_pos")
    for i in range(0, 4096, 500):
        best = {}
        for d, pos in sorted(zip(np.round(knn.matrix_distance(q[i : i + 1], r, "cosine")[0], 12), rp))[:20]:
            best.setdefault(f"R{pos % 9000}", pos)
        assert got[got["query_pos"] == qp[i]]["ref_pos"].tolist() == list(best.values())[:5]
    assert len(got) == 5 * 4096
    assert worker_mb() < max(before, 500)


def test_cosine_matrix_is_given_out_in_slabs(large_sides):
    whole_matrix(large_sides, "cosine")


@pytest.mark.parametrize("metric", knn.METRICS)
@pytest.mark.parametrize("dedupe", [False, True])
def test_whole_rankings(sides, monkeypatch, metric, dedupe):
    """Equal to the merged rankings, for banks, thresholds and accessions with several rows."""
    queries, refs, *_ = sides
    banks = refs.select("ref_pos", F.explode(F.expr("CASE WHEN ref_pos % 3 = 0 THEN array('F', 'P') ELSE array('C') END")).alias("aspect"))
    ask = lambda: sorted(map(tuple, knn.knn_join(queries, refs, 40, metric, 1.1 if metric == "cosine" else 20.0, "block", dedupe=dedupe, banks=banks).withColumn("distance", F.round("distance", 9)).collect()))
    whole = ask()
    monkeypatch.setattr(knn, "WHOLE_BYTES", 0)
    assert whole and whole == ask()


def test_all_references_are_ranked_where_they_meet(large_sides):
    """No pair goes through a sort or an exchange."""
    queries, refs = large_sides
    before = worker_mb()
    got = knn.knn_join(queries.limit(512), refs, 10**9, strategy="block", dim=4)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    assert got.count() == 512 * 16384 and got.where("k_position = 16384").count() == 512
    assert worker_mb() < max(before, 500)


@pytest.mark.parametrize(
    ("dim", "options"),
    [(8, {"dedupe": True}), (8, {"metric": "l2", "distance_threshold": 8.0}), (8, {"pre_normalized": True}), (70, {"by_bank": True})],
)
def test_jvm_strategy_bounds_its_rankings(spark, monkeypatch, dim, options):
    """Few of all pairs are ranked, with the result of the blocks, among copies and with a bank of fewer than k references too."""
    monkeypatch.setattr(knn, "JVM_PAIRS", 0)
    rng = np.random.default_rng(5)
    r, q = rng.normal(size=(400, dim)).astype("f4"), rng.normal(size=(12, dim)).astype("f4")
    r[100:240], q[3] = r[0], r[0]
    refs = spark.createDataFrame([(i, f"R{i // 2}", v.tolist()) for i, v in enumerate(r)], R).cache()
    queries = spark.createDataFrame([(i, f"Q{i}", v.tolist()) for i, v in enumerate(q)], Q).cache()
    options = dict(options)
    if options.pop("by_bank", False):
        options["banks"] = spark.createDataFrame([(i, "F") for i in range(400)] + [(7, "P"), (120, "P")], "ref_pos long, aspect string")
    got, want = (sorted(map(tuple, knn.knn_join(queries, refs, 3, strategy=s, dim=dim, **options).drop("distance").collect())) for s in ("jvm", "block"))
    assert got == want
    assert {x[1] for x in got} == set(range(12))
    pairs = knn._jvm_pairs(queries, refs.withColumn("banks", F.array(F.lit(""))), 3, options.get("metric", "cosine"), options.get("pre_normalized", False), options.get("dedupe", False), dim)
    assert 36 <= pairs.count() < 12 * 400 / 2
