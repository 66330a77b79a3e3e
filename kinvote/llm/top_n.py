"""Top N items within every group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinvote.functions import clean
from kinvote.llm.ranges import numbered, positioned


def top_per_group(items: DataFrame, group: str, score: str, identifier: str, n: int) -> DataFrame:
    """The ``n`` rows of highest score in every group, with their ``position``.

    ``items`` is sorted by range on group, score descending and identifier, so
    a group of any size is spread over tasks; positions are exact by prefix
    sums over the partitions. Ties in the score go to the smaller identifier;
    rows equal in both are separate items in no stated order. Rows with a null
    group, score or identifier belong to no ranking and do not come out. An
    empty table gives an empty result. Further columns are kept, but one named
    ``position`` is replaced by the result's. ``n`` below 1 gives no rows.
    NaN scores count like null ones.
    """
    keys = {group: "g", score: "s", identifier: "i"}
    inner = {c: keys.get(c, f"x{k}") for k, c in enumerate(items.columns)}
    rows = items.select(*[F.col(f"`{c}`").alias(x) for c, x in inner.items()]).dropna(subset=["g", "s", "i"])
    placed = positioned(numbered(rows, "g", ["-s", "i"], keep=max(n, 0)), "g").where(F.col("_pos") <= n)
    return placed.select(*[F.col(x).alias(c) for c, x in inner.items() if c.lower() != "position"], F.col("_pos").alias("position"))


def best_scores(predictions: DataFrame) -> DataFrame:
    """One row per (protein, term) with its highest usable score.

    Scores that are null, NaN or outside 0..1, blank proteins and null terms do
    not count. Repeated deliveries fall together here.
    """
    return (
        predictions.where(clean.usable(F.col("reranker_score")))
        .select(
            clean.protein(F.col("protein_accession")).alias("protein_accession"),
            "go_term_id",
            (F.col("reranker_score") + 0.0).alias("reranker_score"),
        )
        .dropna()
        .groupBy("protein_accession", "go_term_id")
        .agg(F.max("reranker_score").alias("reranker_score"))
    )


def top_terms(predictions: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` best terms of every protein: score descending, then term ascending."""
    return top_per_group(best_scores(predictions), "protein_accession", "reranker_score", "go_term_id", n)
