"""From neighbours and their annotations to one voted row per query and term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinvote.schema import ASPECT_CODES, PAIR_FEATURE_KEYS

TEXT = "string"
#: Size by the optimizer's estimate up to which a term table is sent to all executors.
BROADCAST_BYTES = 16 << 20


def bounded(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if its estimated size is within ``BROADCAST_BYTES``, so that a join on a hot term moves no votes; else as it is, left to adaptive execution, which splits hot keys."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def aspect_order(aspect: str) -> Column:
    """Place of a column's value in the order F, P, C; 0 for the single list of a unified search."""
    place = F.array_position(F.array(*map(F.lit, ASPECT_CODES)), F.col(aspect))
    return F.coalesce(place, F.lit(0)).cast("int")


def distinct_annotations(annotations: DataFrame) -> DataFrame:
    """Annotations without rows that were delivered again: one per reference, position and term."""
    by = ["ref_accession", "ann_pos", "go_term_id"]
    return annotations.dropna(subset=["ref_accession", "go_term_id"]).groupBy(*by).agg(F.min("qualifier").alias("qualifier"), F.min("evidence_code").alias("evidence_code"))


def neighbor_annotations(neighbors: DataFrame, annotations: DataFrame) -> DataFrame:
    """(aspect_key, ref_accession, ann_pos, go_term_id, qualifier, evidence_code) of every reference among the neighbours."""
    return annotations.join(neighbors.select("aspect_key", "ref_accession").distinct(), "ref_accession")


def annotation_frequency(annotations: DataFrame) -> DataFrame:
    """(go_term_id, go_term_frequency): annotation rows per term over the whole table."""
    return annotations.groupBy("go_term_id").agg(F.count(F.lit(1)).alias("go_term_frequency"))


def annotation_density(annotations: DataFrame) -> DataFrame:
    """(ref_accession, ref_annotation_density): annotation rows per reference."""
    return annotations.groupBy("ref_accession").agg(F.count(F.lit(1)).alias("ref_annotation_density"))


def with_distance_std(neighbors: DataFrame) -> DataFrame:
    """Neighbours with the population deviation of all distances of their query (at most k per aspect)."""
    return neighbors.withColumn("neighbor_distance_std", F.stddev_pop("distance").over(Window.partitionBy("query_pos")))


def voters(neighbors: DataFrame, annotations: DataFrame, terms: DataFrame, aspect_separated: bool = False) -> DataFrame:
    """One row per neighbour and annotation, with the term's id and aspect.

    In an aspect-separated search an annotation votes only in its own aspect's
    list. Every annotation row is a vote: a term twice on a reference votes twice.
    """
    named = bounded(terms.select("go_term_id", "go_id", "aspect"))
    rows = neighbors.join(annotations, "ref_accession").join(named, "go_term_id", "left").withColumn("aspect", F.coalesce("aspect", F.lit("")))
    if aspect_separated:
        rows = rows.where(F.col("aspect") == F.col("aspect_key"))
    return rows.withColumn("aspect_ord", aspect_order("aspect_key"))


def tally(votes: DataFrame, k: int) -> DataFrame:
    """One row per (query, term): votes, distances, and the donor, the closest voter.

    Equal distances go to the first voter by aspect order, rank and annotation
    position. ``neighbor_vote_fraction`` divides by the configured ``k``.
    """
    donor = F.struct("ref_accession", "qualifier", "evidence_code")
    place = F.struct("distance", "aspect_ord", "k_position", F.coalesce("ann_pos", F.lit(0)), "ref_pos")
    grouped = votes.groupBy("query_pos", "protein_accession", "go_term_id", "go_id", "aspect").agg(
        F.count(F.lit(1)).alias("vote_count"),
        F.min("k_position").alias("k_position"),
        F.min("distance").alias("min_distance"),
        F.avg("distance").alias("mean_distance"),
        F.max("neighbor_distance_std").alias("neighbor_distance_std"),
        F.min_by(donor, place).alias("donor"),
    )
    return grouped.select(
        *[c for c in grouped.columns if c != "donor"],
        (F.col("vote_count") / float(max(1, k))).alias("neighbor_vote_fraction"),
        F.col("min_distance").alias("distance"),
        F.col("min_distance").alias("neighbor_min_distance"),
        F.col("mean_distance").alias("neighbor_mean_distance"),
        F.col("donor.ref_accession").alias("ref_protein_accession"),
        F.coalesce("donor.qualifier", F.lit("")).alias("qualifier"),
        F.coalesce("donor.evidence_code", F.lit("")).alias("evidence_code"),
    )


def with_aggregates(rows: DataFrame, annotations: DataFrame, counts: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Add the frequency of the term and the density of the donor; 0 where unknown.

    ``counts`` are the results of ``annotation_frequency`` and
    ``annotation_density`` where they are at hand already.
    """
    frequency, density = counts or (annotation_frequency(annotations), annotation_density(annotations))
    density = density.withColumnRenamed("ref_accession", "ref_protein_accession")
    return (
        rows.join(frequency, "go_term_id", "left")
        .join(density, "ref_protein_accession", "left")
        .withColumn("go_term_frequency", F.coalesce("go_term_frequency", F.lit(0)))
        .withColumn("ref_annotation_density", F.coalesce("ref_annotation_density", F.lit(0)))
    )


def one_pair(pair_features: DataFrame, columns: list[str]) -> DataFrame:
    """One row per (protein_accession, ref_accession) with ``columns``; of repeated pairs the least row counts."""
    keys = ["protein_accession", "ref_accession"]
    return pair_features.groupBy(*keys).agg(F.min(F.struct(*columns)).alias("p")).select(*keys, "p.*")


def with_pair_features(rows: DataFrame, pair_features: DataFrame | None) -> DataFrame:
    """Add the pair columns of (query, donor); all null where the pair or a column is missing."""
    if pair_features is None:
        there, out = [], rows
    else:
        there = [c for c in PAIR_FEATURE_KEYS if c in pair_features.columns]
        out = rows
    if there:
        pairs = one_pair(pair_features, there).withColumnRenamed("ref_accession", "ref_protein_accession")
        out = rows.join(pairs, ["protein_accession", "ref_protein_accession"], "left")
    for c in PAIR_FEATURE_KEYS:
        kind = TEXT if c == "taxonomic_relation" else "double"
        out = out.withColumn(c, F.col(c).cast(kind) if c in there else F.lit(None).cast(kind))
    return out
