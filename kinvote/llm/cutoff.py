"""Score cutoffs that keep a target fraction of every source's records."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinvote.functions import clean
from kinvote.llm.ranges import partitions
from kinvote.sources.scratch import cut

# Shares to keep of each aspect.
ASPECT_TARGETS = {"F": "0.30", "P": "0.15", "C": "0.45"}


def ranked(records: DataFrame, source: str, score: str, identifier: str) -> DataFrame:
    """``records`` sorted by range on source, score descending and identifier, as a written table.

    ``_row`` grows in the sorted order: partition number and row within it.
    """
    keys = [F.col(source), F.col(score).desc(), F.col(identifier)]
    spread = records.repartitionByRange(partitions(records), *keys).sortWithinPartitions(*keys)
    return cut(spread.withColumn("_row", F.monotonically_increasing_id()).withColumn("_pid", F.shiftright("_row", 33)), "cutoff")


def cutoffs(table: DataFrame, source: str, score: str, targets: dict[str, str]) -> DataFrame:
    """One row per source of ``targets`` that has records: ``target``, ``cutoff``, ``total``, ``kept``.

    Counts per (partition, source) are prefix-summed to find the partition
    that holds the record at the target position; that row is read. All
    records at the cutoff are kept, so ``kept`` may exceed the target.
    """
    spark = table.sparkSession
    shares = spark.createDataFrame(
        [(k, Decimal(str(v))) for k, v in targets.items()],
        T.StructType([T.StructField("_source", table.schema[source].dataType), T.StructField("target", T.DecimalType(18, 12))]),
    )
    counts = table.groupBy(F.col(source).alias("_source"), "_pid").agg(F.count(F.lit(1)).alias("n"), F.min("_row").alias("first"))
    before = Window.partitionBy("_source").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("_source")
    placed = (
        counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("total", F.sum("n").over(every))
        .join(F.broadcast(shares), "_source")
        .withColumn("want", F.greatest(F.least(F.ceil(F.col("target") * F.col("total")), "total"), F.lit(1)).cast("long"))
        .where((F.col("before") < F.col("want")) & (F.col("want") <= F.col("before") + F.col("n")))
        .select("_source", "target", "total", (F.col("first") + F.col("want") - F.col("before") - 1).alias("_at"))
    )
    # One place per source of ``targets``, so the table itself is not moved to find the rows.
    found = table.join(F.broadcast(placed), (table[source] == placed["_source"]) & (table["_row"] == placed["_at"])).select(
        placed["_source"], placed["target"], table[score].alias("cutoff"), placed["total"]
    )
    found = cut(found, "cutoff-rows")
    kept = table.join(F.broadcast(found), (table[source] == found["_source"]) & (table[score] >= found["cutoff"])).groupBy("_source").agg(F.count(F.lit(1)).alias("kept"))
    return found.join(kept, "_source").select(F.col("_source").alias(source), "target", "cutoff", "total", "kept")


def keep_fraction(records: DataFrame, source: str, score: str, identifier: str, targets: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(kept records, cutoffs) for a target share per source.

    The cutoff of a source is its highest score c such that at least the
    target share of its records score c or more; ties at c are all kept. A
    share is exact decimal arithmetic; a share of 0 still keeps the best score.
    ``targets`` names the sources (a parameter, so small by nature): records of
    other sources, and records with a null source, score or identifier, come
    under no cutoff and are not kept. A source without records has no cutoff
    row. Repeated rows count as often as they are given; extra columns stay,
    whatever their names. NaN scores count like null ones.
    """
    keys = {source: "g", score: "s", identifier: "i"}
    inner = {c: keys.get(c, f"x{k}") for k, c in enumerate(records.columns)}
    rows = records.select(*[F.col(f"`{c}`").alias(x) for c, x in inner.items()]).dropna(subset=["g", "s", "i"]).where(F.col("g").isin(*targets))
    table = ranked(rows, "g", "s", "i")
    report = cut(cutoffs(table, "g", "s", targets), "cutoffs")
    limits = report.select(F.col("g").alias("_source"), F.col("cutoff").alias("_cutoff"))
    kept = table.join(F.broadcast(limits), (table["g"] == limits["_source"]) & (table["s"] >= limits["_cutoff"]))
    return kept.select(*[F.col(x).alias(c) for c, x in inner.items()]), report.withColumnRenamed("g", source)


def scored_ids(predictions: DataFrame) -> DataFrame:
    """One row per prediction_id that has a usable score under aspect F, P or C.

    Where deliveries of one id differ, its highest usable score and its first
    aspect in the alphabet count.
    """
    return (
        predictions.where(clean.usable(F.col("reranker_score")))
        .select("prediction_id", clean.aspect(F.col("aspect")).alias("aspect"), (F.col("reranker_score") + 0.0).alias("reranker_score"))
        .dropna()
        .groupBy("prediction_id")
        .agg(F.min(F.ascii("aspect")).alias("aspect"), F.max("reranker_score").alias("reranker_score"))
        .select("prediction_id", F.chr("aspect").alias("aspect"), "reranker_score")
    )


def aspect_cutoffs(predictions: DataFrame, targets: dict[str, str] = ASPECT_TARGETS) -> tuple[DataFrame, DataFrame]:
    """(kept prediction ids, cutoff per aspect)."""
    return keep_fraction(scored_ids(predictions), "aspect", "reranker_score", "prediction_id", targets)
