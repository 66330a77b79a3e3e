"""Label transfer end to end: neighbours, votes, features, scores."""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinvote.functions.vectors import finite
from kinvote.operators import enrich, votes
from kinvote.operators.knn import common_dim, knn_join, refs_by_aspect, written
from kinvote.operators.pca import PcaState
from kinvote.operators.score import Model, apply_reranker, score_by_aspect
from kinvote.schema import PREDICTION_COLUMNS


@dataclass(frozen=True)
class LabelTransferConfig:
    """Switches of ``predict``; the defaults are those of production.

    ``strategy`` is one of ``knn.STRATEGIES``; ``dim`` is the length of the
    vectors, by default the most frequent one of the references;
    ``prediction_set_id`` is copied to every row.
    """

    k: int = 5
    metric: str = "cosine"
    strategy: str = "auto"
    distance_threshold: float | None = None
    aspect_separated: bool = False
    compute_v6_features: bool = True
    compute_taxonomy: bool = False
    pre_normalized: bool = False
    dedupe: bool = False
    prediction_set_id: str | None = None
    calibration: str = "auto"
    dim: int | None = None


class Diagnostics(NamedTuple):
    """The neighbours of a prediction and their annotations, per aspect key."""

    neighbors: DataFrame
    neighbor_annotations: DataFrame


def nearest(queries: DataFrame, refs: DataFrame, annotations: DataFrame, terms: DataFrame, config: LabelTransferConfig) -> DataFrame:
    """Neighbours with the deviation of their distances, as a written table.

    Queries without a usable vector get none; their number is a warning. Any
    other query must have got neighbours unless a threshold or an approximate
    strategy can leave it without: else the search has lost it (RuntimeError).
    """
    banks = refs_by_aspect(refs, annotations, terms) if config.aspect_separated else None
    dim = config.dim or common_dim(refs)
    found = knn_join(queries, refs, config.k, config.metric, config.distance_threshold, config.strategy, config.pre_normalized, config.dedupe, banks, dim)
    near = written(votes.with_distance_std(found))
    check_answers(queries, near, dim, config)
    return near


def check_answers(queries: DataFrame, near: DataFrame, dim: int, config: LabelTransferConfig) -> None:
    """Compare the queries that should have neighbours with those that have; without references (``dim`` 0) none has."""
    if not dim:
        return
    asked, fine = queries.agg(F.count(F.lit(1)), F.count_if(finite(F.col("embedding"), dim))).first()
    if asked > fine:
        warnings.warn(f"{asked - fine} of {asked} queries have no usable vector of length {dim}", stacklevel=3)
    got = near.select("query_pos").distinct().count()
    if 0 < got < fine and config.k and config.distance_threshold is None:
        said = f"{fine - got} of {fine} queries with a usable vector have no neighbour"
        if config.strategy not in ("ivf", "lsh"):
            raise RuntimeError(said)
        warnings.warn(said, stacklevel=3)


def predict(
    queries: DataFrame, refs: DataFrame, annotations: DataFrame, terms: DataFrame, config: LabelTransferConfig | None = None, *,
    pair_features: DataFrame | None = None, term_vectors: DataFrame | None = None, pca_state: PcaState | None = None,
    model: Model | None = None, models_by_aspect: dict[str, Model] | None = None, feature_cols: list[str] | None = None,
    return_diagnostics: bool = False, counts: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame | tuple[DataFrame, Diagnostics]:
    """One row per query and candidate term, with the columns ``schema.PREDICTION_COLUMNS``.

    Query accessions must be unique (ValueError). Models per aspect take
    precedence over a single one; a model is a tree ensemble or an
    ``ExternalModel``. ``counts`` are the term frequencies and reference
    densities of the annotations where they are known. Empty inputs give an empty result of the same
    columns. Rows come unordered.
    """
    config = config or LabelTransferConfig()
    if queries.groupBy("protein_accession").count().where("count > 1").limit(1).count():
        raise ValueError("query accessions must be unique")
    near = nearest(queries, refs, annotations, terms, config)
    rows = votes.tally(votes.voters(near, annotations, terms, config.aspect_separated), config.k)
    rows = votes.with_pair_features(votes.with_aggregates(rows, annotations, counts), pair_features)
    rows = rows.withColumn("prediction_set_id", F.lit(config.prediction_set_id).cast("string"))
    if config.compute_v6_features:
        rows = enrich.enrich_v6_features(
            rows, near, annotations, terms, queries, term_vectors=term_vectors, pair_features=pair_features, pca_state=pca_state, compute_taxonomy=config.compute_taxonomy
        )
    if models_by_aspect:
        rows = score_by_aspect(written(rows), models_by_aspect, feature_cols, config.calibration)
    elif model is not None:
        rows = apply_reranker(written(rows), model, feature_cols, config.calibration)
    out = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in PREDICTION_COLUMNS.items()])
    if return_diagnostics:
        return out, Diagnostics(near, votes.neighbor_annotations(near, annotations))
    return out
