from __future__ import annotations

import pytest
from kinvote.operators import skew
from kinvote.sources.scratch import cut
from pyspark.sql import functions as F


def measures():
    return [skew.Measure("n", F.lit(1)), skew.Measure("s", F.col("v")), skew.Measure("lo", F.col("v"), "min"), skew.Measure("hi", F.col("v"), "max")]


def hot(spark, parts=12):
    """3,000 rows, a third of them under key 7."""
    return spark.range(0, 3000, numPartitions=parts).select((F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50)).alias("k"), F.when(F.col("id") % 11 != 0, F.col("id")).alias("v"), F.lit("x").alias("_node"))


@pytest.mark.parametrize("fan_in,chunk_rows", [(2, 40), (3, 7), (16, 100_000)])
def test_tree_equals_group_by(spark, fan_in, chunk_rows):
    rows = hot(spark)
    tree = skew.tree_aggregate(rows, ["k"], measures(), fan_in, chunk_rows)
    flat = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    assert sorted(map(tuple, tree.collect())) == sorted(map(tuple, flat.collect()))


def exchanges(df):
    """Shuffles of the plan before adaptive execution."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("partitions", [4, 16, 200])
def test_rounds_do_not_depend_on_the_session(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        tree = skew.tree_aggregate(hot(spark, 4), ["k"], measures(), fan_in=4, chunk_rows=100)
        assert exchanges(tree) == 3  # 4 tasks of 8 chunks are 32 leaves: 4 ** 3 is the first power beyond them
        assert tree.count() == 50
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_no_reducer_gets_more_states_of_a_key_than_the_fan_in(spark):
    fan_in = 4
    rows, leaves = skew.chunked(cut(hot(spark, 4), "rows"), 100)
    assert rows.groupBy("_node").count().agg(F.max("count")).first()[0] == 100
    states = rows.where("k = 7").select("_node").distinct()
    for _ in range(skew.levels(leaves, fan_in)):
        up = states.withColumn("up", F.floor(F.col("_node") / fan_in))
        assert up.groupBy("up").count().agg(F.max("count")).first()[0] <= fan_in
        states = up.select(F.col("up").alias("_node")).distinct()
    assert [r[0] for r in states.collect()] == [0]


def test_counted_join_spreads_hot_keys(spark):
    rows = hot(spark).select("k", "v").unionByName(spark.createDataFrame([(None, 1)], "k long, v long"))
    each = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))
    want = sorted(map(tuple, rows.join(each, "k").select("k", "v", "top").collect()), key=repr)
    for bound in (10, 300, 10**6):
        assert sorted(map(tuple, skew.counted_join(rows, each, ["k"], "n", ["v"], bound).select("k", "v", "top").collect()), key=repr) == want


def test_levels():
    assert [skew.levels(n, 4) for n in (0, 1, 4, 5, 16, 17, 64)] == [1, 1, 1, 2, 2, 3, 3]
    with pytest.raises(ValueError, match="fan_in"):
        skew.tree_aggregate(None, [], [], 1)


def test_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame([(None, 1), (None, None), (1, None)], "k int, v int")
    out = {r["k"]: (r["n"], r["s"]) for r in skew.tree_aggregate(rows, ["k"], [skew.Measure("n", F.lit(1)), skew.Measure("s", F.col("v"))]).collect()}
    assert out == {None: (2, 1), 1: (1, None)}
    assert skew.tree_aggregate(rows.limit(0), ["k"], [skew.Measure("n", F.lit(1))]).count() == 0


def test_term_results(spark):
    notes = spark.createDataFrame([("R1", 1), ("R1", 1), ("R2", 1), ("R1", 2), (None, 2), ("R3", None)], "ref_accession string, go_term_id long").withColumn("n_rows", F.lit("clash"))
    nan = float("nan")
    votes = spark.createDataFrame([("q1", 1, 0.5), (" Q1\t", 1, 0.25), ("Q1", 2, nan), ("Q2", 2, 7.0), ("  ", 2, 0.1), (None, 3, 0.1)], "protein_accession string, go_term_id long, reranker_score double")
    got = {(r["table_name"], r["go_term_id"]): r for r in skew.term_results(notes, votes).collect()}
    assert {k: (r["n_rows"], r["n_pairs"]) for k, r in got.items()} == {("annotations", 1): (3, 2), ("annotations", 2): (1, 1), ("predictions", 1): (2, 1), ("predictions", 2): (2, 2)}
    one, two = got["predictions", 1], got["predictions", 2]
    assert (one["score_mean"], one["score_min"], one["score_max"]) == (0.375, 0.25, 0.5)
    assert (two["n_scored"], two["score_mean"]) == (0, None)
    assert {(r["table_name"], r["go_term_id"]) for r in skew.heavy_terms(notes, votes, percent=60).collect()} == {("annotations", 1), ("predictions", 2)}
