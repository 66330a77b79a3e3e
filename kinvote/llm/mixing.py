"""Mixing sources to target shares of the total size."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinvote.functions import clean
from kinvote.llm.ranges import numbered, positioned
from kinvote.llm.tokens import VOCABULARY, measured, spread
from kinvote.sources.scratch import cut

#: Most sources that a target table may list; it is a configuration, not data.
MAX_SOURCES = 100_000
SEED = 17

_PLAN = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("_key", T.StringType()),
        T.StructField("target_share", T.DoubleType()),
        T.StructField("max_repeats", T.IntegerType()),
        T.StructField("own_tokens", T.LongType()),
        T.StructField("budget", T.LongType()),
        T.StructField("full", T.IntegerType()),
        T.StructField("rest", T.LongType()),
        T.StructField("_wanted", T.DecimalType(38, 18)),
    ]
)


def plan(targets: list[tuple], own: dict[str, int]) -> list[tuple]:
    """Per source of ``targets`` (name, key, share, repeats): its budget, full epochs and the rest.

    The total is what all listed sources have; a budget is the share of it in
    whole tokens. A source that cannot reach its share with all its repeats
    gives all of them. A null share or repeat count is 0.
    """
    total, out = sum(own.get(t[1], 0) for t in targets), []
    for name, key, share, repeats in targets:
        mine, repeats = own.get(key, 0), max(int(repeats or 0), 0)
        wanted = Decimal(str(share or 0)) * total
        give = min(repeats * mine, int(wanted))
        full = give // mine if mine else 0
        out.append((name, key, float(share or 0), repeats, mine, int(wanted), full, give - full * mine, wanted))
    return out


def mixture(records: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(uses, report) for ``records`` (doc_id L, source S, n_tokens L) and ``targets`` (source, target_share, max_repeats).

    ``uses`` has one row per use of a document: ``doc_id``, ``source`` as in
    ``targets``, ``epoch`` from 1 and ``n_tokens`` used. Documents are put in
    an order of random hash keys, sorted by range within each source; distributed
    prefix sums of their tokens give the exact place where the source's budget
    ends. The document across that place is used up to it, so every source that
    is not short gives exactly its budget. A source smaller than its budget is
    repeated in whole epochs before the cut one.

    ``report`` has for every target its budget, ``used_tokens``, ``actual_share``
    of the mixture, ``epochs`` and ``short``, whether the uses hold all that the source can give and yet less than its share. Records of other or null sources
    are not used; null or negative sizes count as 0 and such documents take
    part in full epochs without tokens. Repeated records count as often as they
    are given. Two targets that agree in their normal form are refused.
    """
    spark = records.sparkSession
    listed = targets.select("source", clean.source_key(F.col("source")), "target_share", "max_repeats").limit(MAX_SOURCES + 1).collect()
    if len(listed) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    listed = [tuple(t) for t in listed if t[1] is not None]
    if len({t[1] for t in listed}) < len(listed):
        raise ValueError("targets name a source twice")
    names = F.broadcast(spark.createDataFrame([(t[1],) for t in listed], "_key string"))
    rows = (
        records.select("doc_id", clean.source_key(F.col("source")).alias("_key"), F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).cast("long").alias("n_tokens"))
        .join(names, "_key", "left_semi")
        .withColumn("_hash", F.xxhash64(F.lit(SEED), "doc_id"))
    )
    table = numbered(rows, "_key", ["_hash", "doc_id"], weight="n_tokens")
    # The largest running sum of each (partition, source) is its total: as many rows as partitions and sources.
    own = {r["_key"]: r["n"] for r in table.groupBy("_pid", "_key").agg(F.max("_run").alias("n")).groupBy("_key").agg(F.sum("n").alias("n")).collect()}
    quotas = spark.createDataFrame(plan(listed, own), _PLAN)
    placed = positioned(table, "_key").join(F.broadcast(quotas), "_key")
    taken = F.least("n_tokens", F.greatest(F.lit(0), F.col("rest") - F.col("_run") + F.col("n_tokens")))
    uses = (
        placed.withColumn("_last", taken)
        .withColumn("_times", F.col("full") + (F.col("_last") > 0).cast("int"))
        .where("_times > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(1), "_times")))
        .select("doc_id", "source", "epoch", F.when(F.col("epoch") <= F.col("full"), F.col("n_tokens")).otherwise(F.col("_last")).alias("n_tokens"))
    )
    used = uses.groupBy("source").agg(F.sum("n_tokens").alias("used_tokens"), F.max("epoch").alias("epochs"))
    used = cut(quotas.drop("_key").join(used, "source", "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0))), "mixture")
    everything = used.agg(F.sum("used_tokens").alias("_all"))
    report = used.join(F.broadcast(everything)).select(
        "source", "target_share", F.try_divide("used_tokens", "_all").alias("actual_share"), "own_tokens", "budget", "used_tokens", F.coalesce("epochs", F.lit(0)).alias("epochs"), "max_repeats", ((F.col("used_tokens") == F.col("max_repeats") * F.col("own_tokens")) & (F.col("used_tokens") < F.col("_wanted"))).alias("short")
    )
    return uses, report


def mix_documents(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(uses, report) of the mixture of ``documents`` (doc_id, source, text) under ``targets``."""
    sized = cut(measured(spread(documents.select("doc_id", "source", "text"), "doc_id"), vocabulary=vocabulary).drop("content"), "tokens")
    return mixture(sized, targets)
