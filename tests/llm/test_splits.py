from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from kinvote.llm import splits

SCHEMA = "example_id long, protein_accession string, seq_checksum string, label int, split string"


def brute_groups(rows):
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for i, keys in rows:
        find(i)
        for k in keys:
            a, b = find(i), find(k)
            if a != b:
                top[a] = b
    members = defaultdict(list)
    for i, _ in rows:
        members[find(i)].append(i)
    return {i: min(v) for v in members.values() for i in v}


def test_groups_on_random_ties(spark):
    r = random.Random(2)
    ids = list(range(200))
    keys = [(i, r.choice("ab"), str(r.randrange(60))) for i in ids for _ in range(r.choice([0, 1, 1, 2, 3]))]
    keys += [(i, "hot", "x") for i in range(0, 60, 2)] + keys[:9] + [(None, "a", "1"), (5, "a", None)]
    got = splits.groups(spark.createDataFrame([(i,) for i in [*ids, None, 3]], "id long"), spark.createDataFrame(keys, "id long, kind string, key string"))
    own = defaultdict(list)
    for i, kind, key in keys:
        if i is not None and key is not None:
            own[i].append(f"{kind}:{key}")
    want = brute_groups([(i, own[i]) for i in ids])
    size = Counter(want.values())
    assert {x["id"]: (x["group_id"], x["group_size"]) for x in got.collect()} == {i: (g, size[g]) for i, g in want.items()}


def test_dirty_keys(spark):
    rows = [
        (1, "Q00000001", "AB ", 1, "x"), (2, "sp|q00000001|X_1", None, 0, "x"), (3, "unknown", " ab", None, "x"), (4, "-", "-", 1, "x"), (5, None, "NULL", 1, "x"),
        (6, "", "000000", 1, "x"), (7, "db:Q00000002-1", "0000", 0, "x"), (7, " Q00000002", "none", 0, "x"), (8, "q00000002.3", "n/a", 1, "x"), (None, "Q00000001", "ab", 1, "x"),
    ]
    got = {r["example_id"]: r for r in splits.split_training_rows(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i: r["group_id"] for i, r in got.items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 7}
    for a, b in ((1, 2), (1, 3), (7, 8)):
        assert got[a]["split"] == got[b]["split"]


def test_shares_and_labels_are_met(spark):
    r, rows = random.Random(6), []
    for g in range(700):
        for _ in range(r.choice([1, 1, 1, 2, 3, 5, 40 if g % 50 == 0 else 1])):
            rows.append((len(rows), f"Q{g:08d}", None, int(r.random() < 0.3), "x"))
    got = splits.split_training_rows(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    assert all(len({x["split"] for x in got if x["group_id"] == g}) == 1 for g in {x["group_id"] for x in got})
    size = Counter(x["split"] for x in got)
    ones = Counter(x["split"] for x in got if rows[x["example_id"]][3])
    rate = sum(ones.values()) / len(rows)
    for name, share in splits.SPLITS.items():
        assert abs(size[name] - share * len(rows)) <= 2
        assert ones[name] / size[name] == pytest.approx(rate, abs=0.04)


def test_no_rows(spark):
    assert splits.split_training_rows(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_allocation_is_whole_and_close(seed):
    r = random.Random(seed)
    bundles = [(size, min(size, r.randrange(size + 1)), r.choice([1, 1, 2, 7, 1000])) for size in r.choices([1, 2, 3, 10, 500], k=40)]
    counts = splits.allocate(bundles, [0.8, 0.1, 0.1])
    assert [sum(c) for c in counts] == [b[2] for b in bundles]
    assert all(x >= 0 for c in counts for x in c)
    total = sum(b[0] * b[2] for b in bundles)
    for s, p in enumerate((0.8, 0.1, 0.1)):
        assert abs(sum(b[0] * c[s] for b, c in zip(bundles, counts)) - p * total) <= max(b[0] for b in bundles)


def test_flow_is_of_least_cost():
    import itertools

    r = random.Random(9)
    for _ in range(20):
        costs = [tuple(r.randrange(9) for _ in range(3)) for _ in range(6)]
        quotas = [3, 2, 1]
        flow = splits._Flow([tuple(map(float, c)) for c in costs], quotas)
        assert [flow.at.count(s) for s in range(3)] == quotas
        best = min(sum(c[s] for c, s in zip(costs, a)) for a in itertools.product(range(3), repeat=6) if [a.count(s) for s in range(3)] == quotas)
        assert sum(c[s] for c, s in zip(costs, flow.at)) == best


def test_many_bundles_are_merged(spark, monkeypatch):
    monkeypatch.setattr(splits, "MAX_BUNDLES", 64)
    rows = [(g * 1000 + i, f"Q{g:08d}", None, int(i < g % 7), "x") for g in range(1, 90) for i in range(g)]
    got = splits.split_training_rows(spark.createDataFrame(rows, SCHEMA))
    assert got.count() == len(rows)
    assert got.select("group_id", "split").distinct().count() == 89


def test_coarser_bundles_still_meet_the_shares(spark, monkeypatch):
    """3,000 groups of hundreds of sizes and profiles in at most 300 bundles."""
    r, rows = random.Random(8), []
    for g in range(3000):
        size = int(r.paretovariate(1.2)) if g % 3 else r.randrange(1, 90)
        rate = r.random()
        rows += [(len(rows) + i, f"Q{g:08d}", None, int(r.random() < rate), "x") for i in range(min(size, 400))]
    assert len({(sum(1 for _ in own), sum(x[3] for x in own)) for own in _by_group(rows)}) > 700
    monkeypatch.setattr(splits, "MAX_BUNDLES", 300)
    got = splits.split_training_rows(spark.createDataFrame(rows, SCHEMA)).collect()
    size = Counter(x["split"] for x in got)
    ones = Counter(x["split"] for x in got if rows[x["example_id"]][3])
    for name, share in splits.SPLITS.items():
        assert abs(size[name] / len(rows) - share) <= 0.01
        assert ones[name] / size[name] == pytest.approx(sum(ones.values()) / len(rows), abs=0.03)


def _by_group(rows):
    own = defaultdict(list)
    for x in rows:
        own[x[1]].append(x)
    return own.values()
