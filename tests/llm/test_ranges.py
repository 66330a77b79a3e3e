"""Top N, cutoffs and mixtures against plain Python."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import pytest
from kinvote.llm import cutoff, mixing, ranges, top_n
from pyspark.sql import functions as F


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_numbered_and_positioned(spark):
    r = random.Random(3)
    data = [("hot" if r.random() < 0.4 else f"g{r.randrange(6)}", r.randrange(5), i, r.randrange(4)) for i in range(400)]
    df = spark.createDataFrame(data, "g string, s int, i long, w long")
    got = ranges.positioned(ranges.numbered(df, "g", ["-s", "i"], weight="w"), "g").collect()
    want, last, n, total = {}, None, 0, 0
    for g, s, i, w in sorted(data, key=lambda x: (x[0], -x[1], x[2])):
        n, total = (n + 1, total + w) if g == last else (1, w)
        last = g
        want[i] = (n, total)
    assert {x["i"]: (x["_pos"], x["_run"]) for x in got} == want
    assert len({x["_pid"] for x in got if x["g"] == "hot"}) > 1  # the hot group is spread


@pytest.mark.parametrize("n", [0, 1, 3, 1000])
def test_top_per_group(spark, n):
    r = random.Random(n)
    nan = float("nan")
    data = [(r.choice(["a", "a", "a", "b", "c", None]), r.choice([0.5, 0.5, 0.25, r.random(), None, nan]), r.randrange(40) if i % 13 else None, i) for i in range(300)]
    df = spark.createDataFrame(data, "g string, s double, i long, position long")
    got = top_n.top_per_group(df, "g", "s", "i", n).collect()
    want = []
    for g in "abc":
        own = sorted([(-x[1], x[2]) for x in data if x[0] == g and x[1] is not None and not math.isnan(x[1]) and x[2] is not None])[:n]
        want += [(g, -s, i, k + 1) for k, (s, i) in enumerate(own)]
    assert sorted((x["g"], x["s"], x["i"], x["position"]) for x in got) == sorted(want)


def test_top_of_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 1.0, 1, 5, 6, 7), ("a", 2.0, 2, 8, 9, 9)], "g string, s double, i long, _pos long, `x 1` long, Position long")
    got = top_n.top_per_group(df, "g", "s", "i", 1)
    assert got.columns == ["g", "s", "i", "_pos", "x 1", "position"]
    assert rows_of(got) == [("a", 2.0, 2, 8, 9, 1)]
    assert top_n.top_per_group(df.limit(0), "g", "s", "i", 3).count() == 0


def test_top_terms_reads_dirty_predictions(spark):
    nan, inf = float("nan"), float("inf")
    data = [(" q1", 7, 0.5), ("Q1\t", 7, 0.9), ("Q1", 8, 0.9), ("Q1", 9, nan), ("Q1", 10, inf), ("Q1", 11, 1.5), ("Q1", 12, None), (None, 7, 0.5), (" ", 7, 0.5), ("q2", 7, -0.0), ("Q2", None, 0.3)]
    got = top_n.top_terms(spark.createDataFrame(data, "protein_accession string, go_term_id long, reranker_score double"), 2)
    assert rows_of(got) == [("Q1", 7, 0.9, 1), ("Q1", 8, 0.9, 2), ("Q2", 7, 0.0, 1)]


def brute_cutoffs(data, targets):
    out = {}
    for g, share in targets.items():
        own = sorted((x[1] for x in data if x[0] == g and x[1] is not None), reverse=True)
        if own:
            c = own[max(1, math.ceil(Fraction(str(share)) * len(own))) - 1]
            out[g] = (c, len(own), sum(s >= c for s in own))
    return out


def test_keep_fraction(spark):
    r = random.Random(8)
    data = [(r.choice(["a", "a", "b", "c", "z", None]), r.choice([0.5, 0.75, round(r.random(), 2), None]), i, "x") for i in range(500)] + [("d", 0.1, 1000, "x")]
    targets = {"a": "0.3", "b": "0.1", "c": "1", "d": "0", "none": "0.5"}
    kept, report = cutoff.keep_fraction(spark.createDataFrame(data, "g string, s double, i long, _pid string"), "g", "s", "i", targets)
    want = brute_cutoffs(data, targets)
    assert {x["g"]: (x["cutoff"], x["total"], x["kept"]) for x in report.collect()} == want
    assert rows_of(kept) == sorted(x for x in data if x[0] in want and x[1] is not None and x[1] >= want[x[0]][0])


def test_keep_fraction_is_exact_and_handles_nothing(spark):
    df = spark.createDataFrame([("a", i / 100, i) for i in range(10)], "g string, s double, i long")
    assert cutoff.keep_fraction(df, "g", "s", "i", {"a": "0.3"})[0].count() == 3
    kept, report = cutoff.keep_fraction(df.limit(0), "g", "s", "i", {"a": "0.3"})
    assert kept.count() == report.count() == 0


def test_scored_ids(spark):
    data = [(1, "F", 0.5), (1, "F", 0.5), (2, " Molecular_Function", 0.25), (3, "p\t", 1.0), (4, "n/a", 0.5), (5, None, 0.5), (6, "C", None), (7, "", 0.1), (None, "F", 0.1)]
    got = cutoff.scored_ids(spark.createDataFrame(data, "prediction_id long, aspect string, reranker_score double"))
    assert rows_of(got) == [(1, "F", 0.5), (2, "F", 0.25), (3, "P", 1.0)]


def records(spark, n=300):
    r = random.Random(5)
    data = [(i, r.choice(["Big", " big", "small_one", "Small-One ", "tiny", "other", None]), r.choice([0, 1, 7, 50, None])) for i in range(n)]
    return data, spark.createDataFrame(data, "doc_id long, source string, n_tokens long").withColumn("epoch", F.lit("clash"))


TARGETS = [("big", 0.2, 2), ("small one", 0.5, 3), ("tiny", 0.28, 1), ("absent", 0.02, 4)]


def test_mixture_gives_budgets_exactly(spark):
    data, df = records(spark)
    uses, report = mixing.mixture(df, spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int"))
    said = {r["source"]: r for r in report.collect()}
    sizes = {i: n or 0 for i, _, n in data}
    own = {"big": 0, "small one": 0, "tiny": 0, "absent": 0}
    names = {"big": "big", "small_one": "small one", "tiny": "tiny"}
    for i, s, _ in data:
        key = (s or "").strip().lower().replace("-", "_").replace(" ", "_")
        if key in names:
            own[names[key]] += sizes[i]
    total = sum(own.values())
    for name, share, repeats in TARGETS:
        row, want = said[name], Fraction(str(share)) * total
        assert row["own_tokens"] == own[name]
        assert row["short"] == (repeats * own[name] < want)
        assert row["used_tokens"] == (repeats * own[name] if row["short"] else math.floor(want))
        assert row["epochs"] <= repeats
    assert sum(r["actual_share"] for r in said.values()) == pytest.approx(1)
    seen = {}
    for r in uses.collect():
        assert 0 <= r["n_tokens"] <= sizes[r["doc_id"]]
        assert (r["doc_id"], r["epoch"]) not in seen
        seen[r["doc_id"], r["epoch"]] = r["n_tokens"]


def test_mixture_of_nothing_and_bad_targets(spark):
    _, df = records(spark)
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    uses, report = mixing.mixture(df.limit(0), targets)
    assert uses.count() == 0 and {r["used_tokens"] for r in report.collect()} == {0}
    assert mixing.mixture(df, targets.limit(0))[1].count() == 0
    with pytest.raises(ValueError, match="twice"):
        mixing.mixture(df, spark.createDataFrame([("a", 0.5, 1), ("A ", 0.5, 1)], targets.schema))
