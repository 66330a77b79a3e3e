"""Principal components of vectors: fit, stored state, projection."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinvote.functions.vectors import dot, doubles
from kinvote.operators.knn import usable
from kinvote.schema import EMBEDDING_PCA_DIM


@dataclass(frozen=True)
class PcaState:
    """Mean (dim) and components (n, dim); of each component the largest entry is positive."""

    mean: list[float]
    components: list[list[float]]


def fit_embedding_pca(vectors: DataFrame, n_components: int = EMBEDDING_PCA_DIM, max_fit_samples: int | None = None, seed: int = 42, embedding: str = "embedding", dim: int | None = None) -> PcaState:
    """Fit on all usable vectors, or on about ``max_fit_samples`` of them, a sample of rows without replacement where there are more.

    The mean and the covariance are accumulated by the executors (Spark ML);
    only a (dim, dim) matrix reaches the driver. At most min(rows, dim)
    components come out. No usable vector is a ValueError.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    rows = usable(vectors, embedding, dim)
    if max_fit_samples is not None and (total := rows.count()) > max_fit_samples:
        rows = rows.sample(max_fit_samples / total, seed)
    sample = rows.select(array_to_vector(doubles(embedding)).alias("v")).persist()
    try:
        n = sample.count()
        if not n:
            raise ValueError("no usable vectors")
        mean = sample.select(Summarizer.mean(F.col("v"))).first()[0].toArray()
        k = min(n_components, n, len(mean))
        found = PCA(k=k, inputCol="v", outputCol="p").fit(sample).pc.toArray().T
    finally:
        sample.unpersist()
    flip = np.sign(found[np.arange(k), np.abs(found).argmax(1)])
    return PcaState(mean.tolist(), (found * flip[:, None]).tolist())


def project(vectors: DataFrame, state: PcaState, embedding: str = "embedding") -> DataFrame:
    """``vectors`` with ``projection``: (v - mean) times each component; null for unusable vectors."""
    centred = F.zip_with(doubles(embedding), F.array(*map(F.lit, state.mean)), lambda x, m: x - m)
    rows = usable(vectors, embedding, len(state.mean)).withColumn("_c", centred)
    return rows.withColumn("projection", F.array(*[dot("_c", F.array(*map(F.lit, c))) for c in state.components])).drop("_c")
