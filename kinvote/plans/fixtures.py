"""Inputs of label transfer that the data directory has no table for, as formulas over its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinvote.functions import clean
from kinvote.operators.pca import PcaState
from kinvote.operators.score import Node, TreeEnsemble
from kinvote.operators.votes import distinct_annotations
from kinvote.sources.tables import table

DIM = 64


def inputs(spark, at) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(queries, refs, annotations, terms); annotations without repeated deliveries."""
    return table(spark, at, "queries"), table(spark, at, "refs"), distinct_annotations(table(spark, at, "annotations")), table(spark, at, "terms")


def pair_features(pairs: DataFrame) -> DataFrame:
    """Features of (protein_accession, ref_accession) pairs from the numbers in both accessions; none for every fourth sum."""
    q, r = clean.term_number(F.col("protein_accession")), clean.term_number(F.col("ref_accession"))
    rows = pairs.select("protein_accession", "ref_accession").distinct().select("*", q.alias("q"), r.alias("r")).where("(q + r) % 4 <> 0")
    relations = F.array(*[F.lit(x) for x in ("same", "ancestor", "descendant", "child", "parent", "close", "distant", None)])
    return rows.select(
        "protein_accession", "ref_accession", F.expr("(q * 31 + r * 17) % 100 / 100").alias("identity_nw"), F.expr("50 + q % 200").alias("length_query"),
        F.expr("50 + r % 200").alias("length_ref"), F.expr("(q + r) % 12").alias("taxonomic_distance"),
        F.expr("CASE WHEN (q * r) % 6 <> 0 THEN (q + 2 * r) % 9 END").alias("taxonomic_common_ancestors"), F.element_at(relations, F.expr("CAST((q + r) % 8 AS INT) + 1")).alias("taxonomic_relation"),
    )


#: The other pair columns as formulas of the numbers q and r in both accessions, in Spark and DuckDB alike.
MORE_PAIR_COLUMNS = {
    "similarity_nw": "(q * 7 + r * 3) % 100 / 100",
    "alignment_score_nw": "(q + r) % 300",
    "gaps_pct_nw": "(q * 2 + r) % 50 / 100",
    "alignment_length_nw": "60 + (q + r) % 90",
    "identity_sw": "(q * 13 + r * 5) % 100 / 100",
    "similarity_sw": "(q * 11 + r * 2) % 100 / 100",
    "alignment_score_sw": "(q + 3 * r) % 300",
    "gaps_pct_sw": "(q + r * 2) % 50 / 100",
    "alignment_length_sw": "40 + (q + 2 * r) % 90",
}


def all_pair_features(pairs: DataFrame) -> DataFrame:
    """``pair_features`` with the other columns."""
    q, r = clean.term_number(F.col("protein_accession")), clean.term_number(F.col("ref_accession"))
    rows = pair_features(pairs).select("*", q.alias("q"), r.alias("r"))
    return rows.withColumns({c: F.expr(x) for c, x in MORE_PAIR_COLUMNS.items()}).drop("q", "r")


def coded_ensemble() -> TreeEnsemble:
    """Two trees over a category and two numbers, with sums within 0..1."""
    leaf = lambda x: Node(value=x)
    return TreeEnsemble(
        [
            [Node("aspect", 0.5, 1, 2, True), Node("vote_count", 2.5, 3, 4, False), leaf(0.1), leaf(0.2), leaf(0.3)],
            [Node("evidence_code", categories=(0, 2), left=1, right=2), leaf(0.4), Node("neighbor_vote_fraction", 0.3, 3, 4, True), leaf(0.05), leaf(0.25)],
        ],
        ["aspect", "evidence_code", "vote_count", "neighbor_vote_fraction"],
    )


def term_vectors(spark, at) -> DataFrame:
    """Vectors of terms: the embedding of the same number, some left out and some zero."""
    rows = table(spark, at, "embeddings").where("vec_id % 11 <> 10")
    zero = F.transform("embedding", lambda x: x * 0)
    return rows.select(clean.term_id(F.col("vec_id")).alias("go_id"), F.when(F.col("vec_id") % 13 == 12, zero).otherwise(F.col("embedding")).alias("embedding"))


def parents(spark, at) -> DataFrame:
    """(go_id, parent_id) in one notation."""
    rows = table(spark, at, "term_parents")
    named = lambda c: clean.term_id(clean.term_number(F.col(c))).alias(c)
    return rows.select(named("go_id"), named("parent_id")).dropna().distinct()


def known(spark, at) -> DataFrame:
    """(protein_accession, go_id) that the training rows assert."""
    rows = table(spark, at, "training_rows").where("label = 1")
    return rows.select(clean.accession_core(F.col("protein_accession")).alias("protein_accession"), "go_id").dropna().distinct()


def pca_fixed() -> PcaState:
    """Component i is dimension i plus half of dimension i + 16; the mean is 0.01 everywhere."""
    return PcaState([0.01] * DIM, [[1.0 if j == i else 0.5 if j == i + 16 else 0.0 for j in range(DIM)] for i in range(16)])


def _tree(feature: str, threshold: float, low: float, high: float, default_left: bool, second: tuple[str, float, float, float]) -> list[Node]:
    name, at, a, b = second
    return [Node(feature, threshold, 1, 2, default_left), Node(value=low), Node(name, at, 3, 4, not default_left), Node(value=a), Node(value=b + high)]


def ensemble(scale: float = 1.0) -> TreeEnsemble:
    """Three trees; their sums lie within 0..1 at scale 1 and beyond it at larger scales."""
    return TreeEnsemble(
        [
            _tree("vote_count", 1.5, 0.05 * scale, 0.1 * scale, True, ("min_distance", 0.05, 0.3 * scale, 0.2 * scale)),
            _tree("go_term_frequency", 50.5, 0.1 * scale, 0.05 * scale, True, ("taxonomic_distance", 5.5, 0.2 * scale, 0.1 * scale)),
            _tree("min_distance", 0.2, 0.15 * scale, 0.0, False, ("k_position", 2.5, 0.02 * scale, -0.01 * scale)),
        ]
    )
