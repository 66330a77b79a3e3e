"""Per-key results when a few keys hold most rows: multi-level tree aggregation.

The rows are cut into chunks of a fixed number. Chunks are combined where they
lie; the partial states then meet in rounds, at most ``fan_in`` chunks or nodes
of the round before at a reducer, until one state per key is left. No reducer
ever receives the partials of all chunks, however many rows or chunks a key has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinvote.functions import clean
from kinvote.sources.scratch import cut

_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}

#: Rows of a chunk and children of a node; parameters of the tree, whatever the session's settings.
CHUNK_ROWS = 32_768
FAN_IN = 8


@dataclass(frozen=True)
class Measure:
    """A mergeable state: ``value`` of each row, combined by ``merge`` (sum, min or max)."""

    name: str
    value: Column
    merge: str = "sum"


def levels(leaves: int, fan_in: int) -> int:
    """Rounds until all of ``leaves`` have met: at least one, and fan_in ** rounds >= leaves."""
    rounds, reach = 1, fan_in
    while reach < leaves:
        rounds, reach = rounds + 1, reach * fan_in
    return rounds


def chunked(rows: DataFrame, chunk_rows: int) -> tuple[DataFrame, int]:
    """A written table with ``_node``, the number of each row's chunk, and a bound of these numbers.

    A chunk is ``chunk_rows`` rows on end of one scan task. The table must be a
    written one: a scan gives its rows in the same order if it is repeated, so
    a lost task cannot move rows to other chunks. Chunks are numbered by task
    and place in it; the bound is the number of tasks times the most chunks of
    one, two numbers from one aggregate.
    """
    row = F.monotonically_increasing_id()  # the task in the upper bits, the row within it in the lower 33
    placed = rows.select("*", F.shiftright(row, 33).alias("_task"), F.floor(row.bitwiseAND((1 << 33) - 1) / chunk_rows).alias("_chunk"))
    last = placed.select("_task", "_chunk").agg(F.max("_task"), F.max("_chunk")).first()
    if last[0] is None:
        return placed.withColumn("_node", F.lit(0).cast("long")).drop("_task", "_chunk"), 0
    return placed.withColumn("_node", F.col("_task") * (last[1] + 1) + F.col("_chunk")).drop("_task", "_chunk"), (last[0] + 1) * (last[1] + 1)


def tree_aggregate(df: DataFrame, keys: list[str], measures: list[Measure], fan_in: int = FAN_IN, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per distinct ``keys`` with the merged ``measures``.

    Keys and measures are written first and cut into chunks of ``chunk_rows``
    rows (see ``chunked``). Before each exchange Spark combines equal (key,
    node) states in place: in the first round those are the rows of a chunk, so a
    hot key leaves it as one state. Round r brings the states of ``fan_in``
    neighbouring nodes together (node = chunk div fan_in^r); the last node is
    the root. Null keys form a group of their own;
    measures skip nulls like the SQL functions and are null if all are. An
    empty table gives no rows; columns that are neither key nor measure are
    not read.
    """
    if fan_in < 2 or chunk_rows < 1:
        raise ValueError("fan_in must be at least 2 and chunk_rows at least 1")
    named = [F.col(k) for k in keys]
    rows = cut(df.select(*named, *[m.value.alias(m.name) for m in measures]), "chunks")
    states, leaves = chunked(rows, chunk_rows)
    for _ in range(levels(leaves, fan_in)):
        states = states.withColumn("_node", F.floor(F.col("_node") / fan_in)).groupBy(*named, "_node").agg(*[_MERGE[m.merge](m.name).alias(m.name) for m in measures])
    return states.drop("_node")


#: Rows of one key that one task of a counted join holds on average at most.
HOT_ROWS = 1_000_000


def counted_join(rows: DataFrame, each: DataFrame, keys: list[str], count: str, spread_by: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of ``rows`` with ``each``, which has one row per ``keys`` and in ``count`` how many of ``rows`` have them.

    Keys of more than ``hot_rows`` rows are spread over tasks by the hash of
    ``spread_by``, and their row in ``each`` is sent to all of these. The hot keys
    are broadcast; there is at most one per ``hot_rows`` rows. ``count`` is
    dropped. Null keys join nothing.
    """
    parts = F.ceil(F.col(count) / hot_rows).cast("int")
    hot = F.broadcast(each.where(F.col(count) > hot_rows).select(*keys, parts.alias("_parts")))
    rows = rows.join(hot, keys, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*spread_by), "_parts").cast("int"), F.lit(0))).drop("_parts")
    each = each.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))).drop(count)
    return rows.join(each, [*keys, "_part"]).drop("_part")


def annotation_pairs(annotations: DataFrame) -> DataFrame:
    """Distinct (reference, term) pairs of annotations with their number of rows."""
    return annotations.dropna(subset=["ref_accession", "go_term_id"]).groupBy("ref_accession", "go_term_id").agg(F.count(F.lit(1)).alias("n_rows"))


def prediction_pairs(predictions: DataFrame) -> DataFrame:
    """Distinct (protein, term) pairs of predictions with rows and usable scores.

    Scores are added up in millionths, so that the sum does not depend on the order.
    """
    score = F.when(clean.usable(F.col("reranker_score")), F.col("reranker_score"))
    return (
        predictions.select(clean.protein(F.col("protein_accession")).alias("protein"), "go_term_id", score.alias("score"))
        .dropna(subset=["protein", "go_term_id"])
        .groupBy("protein", "go_term_id")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count("score").alias("n_scored"), F.sum(F.round(F.col("score") * 1_000_000).cast("long")).alias("score_micros"), F.min("score").alias("score_min"), F.max("score").alias("score_max"))
    )


def term_results(annotations: DataFrame, predictions: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """Per table and term: rows, distinct pairs, the share of all pairs, usable scores.

    Rows without a reference, protein or term are no pairs. The score columns
    are null for annotations and for terms without a usable score.
    """
    one = Measure("n_pairs", F.lit(1).cast("long"))
    rows = Measure("n_rows", F.col("n_rows"))
    notes = tree_aggregate(annotation_pairs(annotations), ["go_term_id"], [rows, one], fan_in)
    scores = [Measure("n_scored", F.col("n_scored")), Measure("score_micros", F.col("score_micros")), Measure("score_min", F.col("score_min"), "min"), Measure("score_max", F.col("score_max"), "max")]
    votes = tree_aggregate(prediction_pairs(predictions), ["go_term_id"], [rows, one, *scores], fan_in)
    both = notes.withColumn("table_name", F.lit("annotations")).unionByName(votes.withColumn("table_name", F.lit("predictions")), allowMissingColumns=True)
    both = cut(both, "term-results")
    totals = both.groupBy("table_name").agg(F.sum("n_pairs").alias("all_pairs"))  # two rows
    return both.join(F.broadcast(totals), "table_name").select(
        "table_name", "go_term_id", "n_rows", "n_pairs", "all_pairs", (F.col("n_pairs") / F.col("all_pairs")).alias("share"),
        "n_scored", "score_micros", (F.try_divide("score_micros", "n_scored") / 1_000_000).alias("score_mean"), "score_min", "score_max",
    )


def heavy_terms(annotations: DataFrame, predictions: DataFrame, percent: int = 3, fan_in: int = FAN_IN) -> DataFrame:
    """The terms that hold at least ``percent`` % of the distinct pairs of their table."""
    return term_results(annotations, predictions, fan_in).where(F.col("n_pairs") * 100 >= F.lit(percent) * F.col("all_pairs"))
