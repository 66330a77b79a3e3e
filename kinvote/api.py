"""The engine's public names in one place."""

from __future__ import annotations

from kinvote import __version__
from kinvote.operators.enrich import enrich_v6_features
from kinvote.operators.knn import knn_join as search_knn
from kinvote.operators.lineage import lineage_features as compute_lineage_features
from kinvote.operators.pca import fit_embedding_pca
from kinvote.operators.score import apply_reranker, load_from_bytes, model_from_string, predict_scores, prepare_dataset
from kinvote.operators.transfer import Diagnostics as PredictDiagnostics
from kinvote.operators.transfer import LabelTransferConfig as PredictConfig
from kinvote.operators.transfer import predict
from kinvote.schema import (
    ALL_FEATURES,
    ASPECT_CODES,
    CATEGORICAL_FEATURES,
    EMBEDDING_PCA_DIM,
    LABEL_COLUMN,
    LINEAGE_FEATURE_KEYS,
    NEW_V6_FEATURE_KEYS,
    NUMERIC_FEATURES,
    POOL_INJECTED_FEATURES,
    REQUIRED_FEATURES,
    infer_active_feature_families,
)
from kinvote.sources.artifacts import TermVectorIndex, external_scorer, get_index, load_or_fit_pca_state
from kinvote.sources.artifacts import TermVectorIndex as Anc2VecIndex
from kinvote.streaming.predict import predict_stream

# The public names.
__all__ = [
    "Anc2VecIndex", "REQUIRED_FEATURES", "external_scorer",
    "ALL_FEATURES", "ASPECT_CODES", "CATEGORICAL_FEATURES", "EMBEDDING_PCA_DIM", "LABEL_COLUMN", "LINEAGE_FEATURE_KEYS",
    "NEW_V6_FEATURE_KEYS", "NUMERIC_FEATURES", "POOL_INJECTED_FEATURES", "PredictConfig", "PredictDiagnostics", "TermVectorIndex", "__version__",
    "apply_reranker", "compute_lineage_features", "enrich_v6_features", "fit_embedding_pca", "get_index", "infer_active_feature_families",
    "load_from_bytes", "load_or_fit_pca_state", "model_from_string", "predict", "predict_scores", "predict_stream", "prepare_dataset", "search_knn",
]
