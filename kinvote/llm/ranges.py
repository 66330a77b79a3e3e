"""Exact positions in a globally range-sorted table.

A table is split by range on (group, order) and sorted within its partitions,
so a group may lie over many partitions and no task ever has to hold one. Each
partition numbers its own rows of every group; only a partition's last group
can go on in the next one, so one summary row per partition is enough to turn
local positions and running sums into global ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kinvote.sources.scratch import cut

ADDED = T.StructType(
    [
        T.StructField("_pid", T.IntegerType()),
        T.StructField("_pos", T.LongType()),
        T.StructField("_run", T.LongType()),
        T.StructField("_tail", T.BooleanType()),
        T.StructField("_single", T.BooleanType()),
    ]
)


#: Bytes of input of a range partition at most on average, as stored.
TASK_BYTES = 256 << 20


def partitions(df: DataFrame) -> int:
    """Range partitions: as many as the session shuffles into, or more if the tables that ``df`` reads are larger than that.

    Their sizes are those of the files; a table without a known size does not count.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.length())]
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sum(s for s in sizes if s < 1 << 60) // TASK_BYTES))


def numbered(df: DataFrame, group: str, order: list[str], weight: str | None = None, keep: int | None = None) -> DataFrame:
    """Sort globally by ``group`` and ``order`` and number the rows of each partition.

    ``group`` is a column without nulls; ``order`` lists columns, descending
    where the name starts with ``-``. Added columns: ``_pid`` partition,
    ``_pos`` 1-based position of the row among the partition's rows of its
    group, ``_run`` running sum of ``weight`` there, ``_tail`` marking the last
    row of the partition and ``_single`` telling whether the partition holds
    only one group. With ``keep``, rows whose local position is beyond it are
    left out (their global position can only be larger), but never the tail.
    The result is a written table.
    """
    schema = T.StructType([*df.schema.fields, *ADDED.fields])
    arrow = to_arrow_schema(schema)
    keys = [F.col(group), *(F.col(c[1:]).desc() if c[0] == "-" else F.col(c) for c in order)]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        last, count, total, groups = None, 0, 0, 0
        held: tuple[pa.RecordBatch, int, int] | None = None

        def out(batch: pa.RecordBatch, pos: np.ndarray, run: np.ndarray, tail: bool, single: bool) -> pa.RecordBatch:
            n = batch.num_rows
            added = [np.full(n, pid, "i4"), pos, run, np.full(n, tail), np.full(n, single)]
            return pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, arrow)), *map(pa.array, added)], schema=arrow)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key = batch.column(group)
            change = np.empty(n, bool)
            change[1:] = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
            change[0] = count == 0 or key[0].as_py() != last
            start = np.maximum.accumulate(np.where(change, np.arange(n), -1))
            fresh = start >= 0  # rows of a group that begins in this batch
            pos = np.arange(n) - np.where(fresh, start, -1 - count + 1) + 1
            if weight is None:
                run = np.zeros(n, "i8")
            else:
                sums = np.cumsum(pc.fill_null(batch.column(weight), 0).to_numpy(zero_copy_only=False).astype("i8"))
                before = np.where(start > 0, sums[np.maximum(start, 1) - 1], 0)
                run = sums - before + np.where(fresh, 0, total)
            groups += int(change.sum())
            last, count, total = key[n - 1].as_py(), int(pos[-1]), int(run[-1])
            if held is not None and (keep is None or held[1] <= keep):
                yield out(held[0], np.array([held[1]]), np.array([held[2]]), False, False)
            held = (batch.slice(n - 1, 1), count, total)
            mask = np.ones(n, bool) if keep is None else pos <= keep
            mask[n - 1] = False
            if mask.any():
                yield out(batch.filter(pa.array(mask)), pos[mask], run[mask], False, False)
        if held is not None:
            yield out(held[0], np.array([held[1]]), np.array([held[2]]), True, groups == 1)

    spread = df.repartitionByRange(partitions(df), *keys).sortWithinPartitions(*keys)
    return cut(spread.mapInArrow(number, schema), "ranges")


def carries(tails: list[Row], group: str) -> list[tuple[int, object, int, int]]:
    """What each partition's first group has in earlier partitions: (partition, group, rows, weight).

    ``tails`` has one row per non-empty partition.
    """
    out, key, rows, weight = [], None, 0, 0
    for t in sorted(tails, key=lambda t: t["_pid"]):
        if rows:
            out.append((t["_pid"], key, rows, weight))
        goes_on = t["_single"] and rows and t[group] == key
        rows, weight = (rows if goes_on else 0) + t["_pos"], (weight if goes_on else 0) + t["_run"]
        key = t[group]
    return out


def positioned(table: DataFrame, group: str) -> DataFrame:
    """Turn the local ``_pos`` and ``_run`` of ``numbered`` into global ones.

    The prefix sums run over one summary row per partition; their number is
    bounded by the session's shuffle partitions, not by the data, and the
    carried offsets are broadcast.
    """
    spark = table.sparkSession
    tails = table.where("_tail").select("_pid", group, "_pos", "_run", "_single").collect()
    kind = table.schema[group].dataType
    offsets = spark.createDataFrame(
        carries(tails, group),
        T.StructType([T.StructField("_at", T.IntegerType()), T.StructField("_key", kind), T.StructField("_rows", T.LongType()), T.StructField("_sum", T.LongType())]),
    )
    joined = table.join(F.broadcast(offsets), (table["_pid"] == offsets["_at"]) & (table[group] == offsets["_key"]), "left")
    return joined.select(
        *[table[c] for c in table.columns if c not in ("_pos", "_run")],
        (table["_pos"] + F.coalesce(offsets["_rows"], F.lit(0))).alias("_pos"),
        (table["_run"] + F.coalesce(offsets["_sum"], F.lit(0))).alias("_run"),
    )
