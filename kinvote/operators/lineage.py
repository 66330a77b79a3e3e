"""Ancestor closures and the lineage features of candidates against known terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinvote.operators.hierarchy import Hierarchy
from kinvote.schema import LINEAGE_FEATURE_KEYS
from kinvote.sources.scratch import cut


def ancestor_closure(seeds: DataFrame, parents: DataFrame) -> DataFrame:
    """(go_id, ancestor): every seed with itself and all it reaches over ``parents`` (go_id, parent_id).

    The terms are numbered and the ancestors of the seeds come from the hierarchy
    operator, which walks up from them within whole components as far as these are bounded
    and joins pairs beyond that; components without a seed take no part,
    diamonds are not repeated and cycles end.
    Terms without parents reach only themselves; null seeds are skipped.
    """
    links = parents.dropna().select("go_id", "parent_id").distinct()
    seeds = seeds.select("go_id").dropna().distinct()
    names = cut(links.select(F.explode(F.array("go_id", "parent_id")).alias("go_id")).distinct().withColumn("node", F.monotonically_increasing_id()), "names")
    child, parent = names.toDF("go_id", "child"), names.toDF("parent_id", "parent")
    wanted = cut(seeds.join(names, "go_id"), "seeds")
    hierarchy = Hierarchy(links.join(child, "go_id").join(parent, "parent_id").select("child", "parent"), names.select("node"))
    pairs = hierarchy.ancestors(wanted).select("node", F.explode("ancestors").alias("above"))
    above = pairs.join(wanted, "node").select("go_id", "above").join(names.toDF("ancestor", "above"), "above").select("go_id", "ancestor")
    return cut(seeds.select("go_id", F.col("go_id").alias("ancestor")).unionByName(above), "closure")


def lineage_features(rows: DataFrame, parents: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` (protein_accession, go_id, ...) with the four lineage columns.

    ``known`` (protein_accession, go_id) are the terms a protein is known to
    have. A candidate counts the known terms that it is an ancestor of and those
    that it descends from, itself left out. Blank or null terms, and proteins
    without known terms, get zeros.
    """
    known = known.dropna().select("protein_accession", F.col("go_id").alias("k")).where("k <> ''").distinct()
    pairs = rows.select("protein_accession", "go_id").where("go_id <> ''").distinct()
    seeds = known.select(F.col("k").alias("go_id")).unionByName(pairs.select("go_id"))
    closure = ancestor_closure(seeds, parents).where("go_id <> ancestor")
    up = pairs.join(known.join(closure.select(F.col("go_id").alias("k"), F.col("ancestor").alias("go_id")), "k"), ["protein_accession", "go_id"]).groupBy("protein_accession", "go_id").agg(F.count(F.lit(1)).alias("over"))
    down = pairs.join(closure, "go_id").join(known.withColumnRenamed("k", "ancestor"), ["protein_accession", "ancestor"]).groupBy("protein_accession", "go_id").agg(F.count(F.lit(1)).alias("under"))
    over, under = F.coalesce("over", F.lit(0)).cast("double"), F.coalesce("under", F.lit(0)).cast("double")
    out = rows.join(up, ["protein_accession", "go_id"], "left").join(down, ["protein_accession", "go_id"], "left")
    values = ((over > 0).cast("double"), (under > 0).cast("double"), over, under)
    return out.withColumns(dict(zip(LINEAGE_FEATURE_KEYS, values))).drop("over", "under")
