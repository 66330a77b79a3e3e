"""Intermediate tables in the folder that all executors share.

``cut`` writes a DataFrame as Parquet and reads it back: the lineage ends
there, so that a lost executor costs a re-read instead of a recomputation, and
a step whose result is read twice (a sampling job, then the real one) runs
once. The folder is ``spark.checkpoint.dir`` of the session; where that is
unset, a temporary one is made for a local master, and any other is refused.
Tables are deleted by ``drop``, at the end of a ``scope``, or with the program.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_local: list[str] = []
_written: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    at = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING) or spark.sparkContext.getCheckpointDir()
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"{_SETTING} must name a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="kinvote-"))
    return f"file://{_local[0]}"


def place(spark: SparkSession, name: str, ending: str = "") -> str:
    """A new path in the shared folder, deleted like the tables of ``cut``."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}{ending}"
    _written.append((spark, path))
    return path


def cut(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table."""
    spark = df.sparkSession
    path = place(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kinvote_path = path
    return out


def drop(df: DataFrame | None) -> None:
    """Delete a table made by ``cut`` that no later plan reads."""
    path = getattr(df, "_kinvote_path", None)
    if path is None:
        return
    _delete(df.sparkSession, path)
    _written[:] = [x for x in _written if x[1] != path]


@contextmanager
def scope() -> Iterator[None]:
    """Delete the tables that were written inside, at the end; results that read them must be consumed before."""
    before = {path for _, path in _written}
    try:
        yield
    finally:
        for spark, path in [x for x in _written if x[1] not in before]:
            _delete(spark, path)
            _written.remove((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _sweep() -> None:
    """At the end of the program its tables are deleted, if the session still lives."""
    import shutil

    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass
    for at in _local:
        shutil.rmtree(at, ignore_errors=True)
