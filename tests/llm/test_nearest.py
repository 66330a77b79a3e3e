from __future__ import annotations

import numpy as np
from kinvote.llm import nearest

Q, R = "query_pos long, protein_accession string, embedding array<float>", "ref_pos long, ref_accession string, embedding array<float>, rank int"


def crowded(n, seed, dim=64):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(n // 12, 1), dim))
    return (centres[rng.integers(len(centres), size=n)] + 0.3 * rng.normal(size=(n, dim))).astype("f4")


def brute(queries, refs, k=5):
    out = {}
    for qp, q in queries:
        best = {}
        for _, name, r in refs:
            d = 1 - float(q @ r) / (np.linalg.norm(q) * np.linalg.norm(r))
            best[name] = min(best.get(name, 9), d)
        out[qp] = sorted(best, key=lambda x: (best[x], x))[:k]
    return out


def test_recall(spark):
    x = crowded(3000, 1)
    refs = [(i, f"R{i // 2 if i < 200 else i}", v * (1 + i % 7)) for i, v in enumerate(x[:2900])]
    queries = [(i, v) for i, v in enumerate(x[2900:])]
    got = nearest.most_similar(spark.createDataFrame([(i, "q", v.tolist()) for i, v in queries], Q), spark.createDataFrame([(*r[:2], r[2].tolist(), 1) for r in refs], R)).collect()
    want = brute([(i, v.astype("f8")) for i, v in queries], [(i, n, v.astype("f8")) for i, n, v in refs])
    found = {i: {r["ref_accession"] for r in got if r["query_pos"] == i} for i in want}
    assert all(len(v) == 5 for v in found.values())
    assert sum(len(found[i] & set(want[i])) for i in want) / (5 * len(want)) >= 0.97
    for i in want:
        own = sorted((r["rank"], r["distance"]) for r in got if r["query_pos"] == i)
        assert [x for _, x in own] == sorted(x for _, x in own)


def test_dirty_vectors_and_copies(spark):
    v = crowded(6, 2)
    nan, inf = float("nan"), float("inf")
    bad = [None, [1.0] * 32, [0.0] * 64, [nan] + [1.0] * 63, [inf] + [1.0] * 63, []]
    refs = [(i, f"B{i}", b, 1) for i, b in enumerate(bad)] + [(100 + i, "A", (v[0] * (i + 1)).tolist(), 1) for i in range(80)] + [(200 + i, f"R{i}", v[i].tolist(), 1) for i in range(1, 6)] + [(300, None, v[0].tolist(), 1)]
    queries = [(1, "q", v[0].tolist()), *[(2 + i, "q", b) for i, b in enumerate(bad)]]
    got = nearest.most_similar(spark.createDataFrame(queries, Q), spark.createDataFrame(refs, R)).collect()
    assert {r["query_pos"] for r in got} == {1}
    assert [r["ref_accession"] for r in sorted(got, key=lambda r: r["rank"])][0] == "A"
    assert len({r["ref_accession"] for r in got}) == 5


def test_empty_sides(spark):
    one = spark.createDataFrame([(1, "q", [1.0] * 64)], Q)
    ref = spark.createDataFrame([(1, "R", [1.0] * 64, 1)], R)
    assert nearest.most_similar(one.limit(0), ref).count() == 0
    assert nearest.most_similar(one, ref.limit(0)).count() == 0
    assert nearest.most_similar(one, ref).count() == 1


def test_hilbert_curve_is_a_walk_over_all_cells():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = nearest.hilbert(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_windows_over_partition_ends(spark):
    """With many small partitions the boundaries are completed from both sides."""
    x = crowded(1200, 4)
    queries = spark.createDataFrame([(i, "q", v.tolist()) for i, v in enumerate(x[:60])], Q)
    refs = spark.createDataFrame([(i, f"R{i}", v.tolist(), 1) for i, v in enumerate(x[60:])], R)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = nearest.most_similar(queries, refs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = brute([(i, v.astype("f8")) for i, v in enumerate(x[:60])], [(i, f"R{i}", v.astype("f8")) for i, v in enumerate(x[60:])])
    hits = sum(r["ref_accession"] in want[r["query_pos"]] for r in got)
    assert hits / 300 >= 0.97


def frames(spark, queries, refs):
    """The two sides of rows (query_pos, vector) and (ref_pos, accession, vector)."""
    return spark.createDataFrame([(i, "q", v.tolist()) for i, v in queries], Q), spark.createDataFrame([(i, n, v.tolist(), 1) for i, n, v in refs], R)


def recall(got, queries, refs):
    """Share of the true five accessions that were found; every query must have five."""
    want = brute([(i, v.astype("f8")) for i, v in queries], [(i, n, v.astype("f8")) for i, n, v in refs])
    found = {i: {r["ref_accession"] for r in got if r["query_pos"] == i} for i in want}
    assert all(len(v) == 5 for v in found.values())
    return sum(len(found[i] & set(want[i])) for i in want) / (5 * len(want))


def test_one_accession_with_a_third_of_the_vectors(spark):
    rng = np.random.default_rng(11)
    centre = rng.normal(size=64)
    x = np.concatenate([crowded(2000, 12), centre + 0.1 * rng.normal(size=(1000, 64))]).astype("f4")
    refs = [(i, f"R{i}" if i < 2000 else "HOT", v) for i, v in enumerate(x)]
    queries = list(enumerate((centre + 0.1 * rng.normal(size=(20, 64))).astype("f4")))
    assert recall(nearest.most_similar(*frames(spark, queries, refs)).collect(), queries, refs) >= 0.97


def test_third_of_the_vectors_near_or_equal_to_one(spark):
    rng = np.random.default_rng(13)
    centre, copy = rng.normal(size=(2, 64))
    x = np.concatenate([crowded(2000, 14), centre + 0.05 * rng.normal(size=(1000, 64)), np.repeat(copy[None], 300, 0)]).astype("f4")
    x = x[rng.permutation(len(x))]
    refs = [(i, f"R{i:04}", v) for i, v in enumerate(x)]
    queries = list(enumerate(np.concatenate([centre + 0.05 * rng.normal(size=(20, 64)), np.repeat(copy[None], 3, 0)]).astype("f4")))
    assert recall(nearest.most_similar(*frames(spark, queries, refs)).collect(), queries, refs) == 1


def test_a_third_of_the_queries_are_one_vector(spark):
    """Partitions that hold queries only are completed from further away than the next one."""
    x = crowded(700, 15)
    refs = [(i, f"R{i}", v) for i, v in enumerate(x)]
    near = x[3] + 0.02 * np.random.default_rng(16).normal(size=(150, 64))  # differ, with hardly a reference between them
    queries = list(enumerate(np.concatenate([np.repeat(x[:1], 400, 0), near, x[600:]]).astype("f4")))
    before, nearest.TASK_ROWS = nearest.TASK_ROWS, 60
    try:
        got = nearest.most_similar(*frames(spark, queries, refs), curves=nearest.Curves(count=4)).collect()
    finally:
        nearest.TASK_ROWS = before
    assert len(got) == 5 * len(queries)
    assert recall(got, queries, refs) >= 0.97


def test_carried_references():
    counts = [("0:2:-1", 3), ("0:3:-1", 40), ("0:9:-1", 32), ("1:1:-1", 32), ("0:9:1", 32)]
    plan = nearest._carried(counts, {"0:7:-1", "0:4:1", "1:1:-1"}, 41)
    assert sorted(plan) == [("0:2:-1", "0:7:-1", 1), ("0:3:-1", "0:7:-1", 40), ("0:9:1", "0:4:1", 32)]


def test_an_accession_counts_at_its_exactly_closest_vector(spark):
    """Vectors that one-byte numbers do not tell apart, under one accession, and the query equal to one of them."""
    rng = np.random.default_rng(17)
    base = crowded(400, 18)
    near = (base[0] + 1e-3 * rng.normal(size=(12, 64))).astype("f4")
    refs = [(i, f"R{i}", v) for i, v in enumerate(base)] + [(1000 + i, "X", v) for i, v in enumerate(near)]
    queries = [(i, v) for i, v in enumerate(near[3:6])]
    got = nearest.most_similar(*frames(spark, queries, refs)).where("rank = 1").collect()
    assert {r["query_pos"]: r["ref_accession"] for r in got} == {0: "X", 1: "X", 2: "X"}
    assert all(abs(r["distance"]) < 1e-12 for r in got)


def test_leading_owners_keep_what_codes_cannot_tell():
    near = np.array([[0.9, 0.5, 0.89999, 0.7, 0.95]], "f4")
    owners = np.array([[1, 2, 1, 1, 3]])
    rows, cols = nearest._leading(near, owners, 2)
    assert sorted(cols.tolist()) == [0, 2, 4] and set(rows.tolist()) == {0}
