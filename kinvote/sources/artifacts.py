"""Artifacts beside the tables: term vectors, PCA states and models."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

import numpy as np
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinvote.functions.vectors import finite
from kinvote.operators.enrich import term_vector_batch
from kinvote.operators.pca import PcaState, fit_embedding_pca
from kinvote.operators.score import ExternalModel, TreeEnsemble, load_from_bytes, model_from_table

#: Session settings for the default places.
TERM_VECTORS_PATH = "spark.kinvote.termVectors.path"
PCA_PATH = "spark.kinvote.pca.path"

_VECTORS = T.StructType([T.StructField("go_id", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("release", T.StringType())])
_STATE = T.StructType([T.StructField("component", T.IntegerType()), T.StructField("weights", T.ArrayType(T.DoubleType()))])

# What Spark's errors say of files that can be read but are no Parquet, or of other columns.
_OTHER_FORMAT = ("is not a Parquet file", "CANNOT_READ_FILE_FOOTER", "PARQUET_COLUMN_DATA_TYPE_MISMATCH", "UNABLE_TO_INFER_SCHEMA")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_term_vectors(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(go_id, embedding, release) from Parquet, or from a NumPy archive with ``embeddings``, ``go_ids`` and maybe ``ontology_release``.

    Without a path the session setting ``spark.kinvote.termVectors.path`` is
    taken. A missing file raises FileNotFoundError. An archive is one file of
    bounded size, read by the driver; at scale keep the vectors as Parquet.
    """
    path = path or spark.conf.get(TERM_VECTORS_PATH, None)
    if not path or not _exists(spark, path):
        raise FileNotFoundError(path or TERM_VECTORS_PATH)
    if not path.endswith(".npz"):
        rows = spark.read.parquet(path)
        return rows if "release" in rows.columns else rows.withColumn("release", F.lit(""))
    with np.load(path.removeprefix("file://"), allow_pickle=True) as data:
        release = str(data["ontology_release"]) if "ontology_release" in data else ""
        rows = [(str(g), list(map(float, v)), release) for g, v in zip(data["go_ids"], data["embeddings"])]
    return spark.createDataFrame(rows, _VECTORS)


class TermVectorIndex:
    """Term vectors with look-ups; the table is kept in the executors' storage until ``close``. Of a repeated id the least vector counts."""

    def __init__(self, vectors: DataFrame) -> None:
        self.table = vectors.dropna(subset=["go_id", "embedding"]).groupBy("go_id").agg(F.min(F.struct("embedding", "release")).alias("v")).select("go_id", "v.*").persist()
        first = self.table.select(F.size("embedding").alias("dim"), "release").first()
        self.dim, self.release = (first["dim"], first["release"]) if first else (0, "")

    def __len__(self) -> int:
        return self.table.count()

    def close(self) -> None:
        self.table.unpersist()

    def __contains__(self, go_id: str) -> bool:
        return bool(self.table.where(F.col("go_id") == go_id).limit(1).count())

    def vec(self, go_id: str) -> list[float] | None:
        """The vector of one term, None if there is none."""
        row = self.table.where(F.col("go_id") == go_id).first()
        return list(row["embedding"]) if row else None

    def batch(self, terms: DataFrame, zero_if_missing: bool = True) -> DataFrame:
        """(go_id, embedding, found) for the terms of a table."""
        return term_vector_batch(terms, self.table, self.dim, zero_if_missing)


@functools.lru_cache(maxsize=2)
def get_index(spark: SparkSession, path: str | None = None) -> TermVectorIndex:
    """The index of a path, once per process."""
    return TermVectorIndex(read_term_vectors(spark, path))


def save_pca_state(spark: SparkSession, state: PcaState, config_id: str, directory: str | None = None) -> None:
    """Write a state as Parquet under ``directory`` / ``config_id``; row -1 is the mean."""
    rows = [(-1, state.mean), *enumerate(state.components)]
    spark.createDataFrame(rows, _STATE).coalesce(1).write.mode("overwrite").parquet(_pca_path(spark, config_id, directory))


def load_pca_state(spark: SparkSession, config_id: str, directory: str | None = None) -> PcaState | None:
    """The state that was saved; None if it is missing or its files are not of this form. Errors of the storage are raised."""
    path = _pca_path(spark, config_id, directory)
    if not _exists(spark, path):
        return None
    try:
        rows = {r["component"]: list(r["weights"]) for r in spark.read.schema(_STATE).parquet(path).collect()}
        return PcaState(rows[-1], [rows[i] for i in range(len(rows) - 1)])
    except KeyError:  # a table without a mean or with a gap
        return None
    except (PySparkException, Py4JError) as x:
        if any(words in str(x) for words in _OTHER_FORMAT):
            return None
        raise


def load_or_fit_pca_state(spark: SparkSession, config_id: str, vectors: DataFrame, directory: str | None = None) -> PcaState | None:
    """A saved state, whatever ``vectors`` are; else one fitted on them and saved; None if there are none."""
    state = load_pca_state(spark, config_id, directory)
    if state is None and vectors.where(finite(F.col("embedding"))).limit(1).count():
        state = fit_embedding_pca(vectors)
        save_pca_state(spark, state, config_id, directory)
    return state


def _pca_path(spark: SparkSession, config_id: str, directory: str | None) -> str:
    return os.path.join(directory or spark.conf.get(PCA_PATH, "artifacts/pca"), str(config_id))


def read_model(spark: SparkSession, path: str) -> TreeEnsemble:
    """A tree ensemble from a file (JSON, or the text format of LightGBM: .json, .txt, .lgb, .model), or from a Parquet table of nodes."""
    if path.endswith((".json", ".txt", ".lgb", ".model")):
        return load_from_bytes(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))
    return model_from_table(spark.read.parquet(path))


def external_scorer(load: Callable, features: list[str]) -> ExternalModel:
    """A model of another library, for every function that takes a ``model``."""
    return ExternalModel(load, features)
