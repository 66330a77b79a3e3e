"""Ranked nearest-neighbour joins: exact in blocks, or approximate over cells or hashes.

Every strategy returns ``neighbors``: aspect_key, query_pos, protein_accession,
k_position, ref_pos, ref_accession, distance. Distances are rounded to 12
decimals, so that vectors that differ only by arithmetic noise tie; ties go to
the smaller ref_pos. Squared distances are sums of squared differences whatever
the strategy and size.

The exact strategies cut both sides into blocks and meet every query block with
every reference block once: the stated queries against all references. A task
holds one pair of blocks, whatever the size of the sides, works on a slab of
its pairs at a time and passes on only its best k of each query, which are
merged per query afterwards. Where all pairs are wanted, the slabs are given
out one by one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kinvote.functions.vectors import EPSILON, dot, doubles, finite, norm, squared_l2
from kinvote.schema import ASPECT_CODES
from kinvote.sources.scratch import cut

METRICS = ("cosine", "l2")
STRATEGIES = ("auto", "block", "jvm", "ivf", "lsh")
#: Rows of a block at most.
QUERY_BLOCK, REF_BLOCK = 4096, 16384
#: The same of queries where every pair is given out.
FULL_QUERY_BLOCK = 1024
#: Pairs whose distances a worker holds at once.
SLAB_PAIRS = 1 << 19
#: Pairs up to which the JVM strategy is chosen by itself, and ranks all pairs.
JVM_PAIRS = 50_000
#: Queries of a block of the JVM strategy; vectors of more numbers than ``WRITTEN_DIM`` would make methods that Java does not compile.
JVM_QUERY_BLOCK, WRITTEN_DIM = 2048, 64
#: Rankings of all references, or of so many, are made whole by tasks that hold all references, if their doubles take up to so many bytes.
WHOLE_K, WHOLE_BYTES = 1000, 1 << 27
#: Pairs of such a task.
WHOLE_PAIRS = 1 << 26
DECIMALS = 12

NEIGHBORS = T.StructType(
    [T.StructField("aspect_key", T.StringType()), T.StructField("query_pos", T.LongType()), T.StructField("ref_pos", T.LongType()), T.StructField("distance", T.DoubleType())]
)


def check_metric(metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {', '.join(METRICS)}")


def distance(q: Column | str, r: Column | str, metric: str, pre_normalized: bool = False) -> Column:
    """Distance of two arrays of doubles as a column."""
    check_metric(metric)
    if metric == "l2":
        return squared_l2(q, r)
    over = norm(q) + EPSILON
    return 1 - dot(q, r) / (over if pre_normalized else over * (norm(r) + EPSILON))


def matrix_distance(q: np.ndarray, r: np.ndarray, metric: str, pre_normalized: bool = False) -> np.ndarray:
    """The same for all pairs of two blocks."""
    check_metric(metric)
    if metric == "l2":
        return np.maximum((q * q).sum(1)[:, None] + (r * r).sum(1)[None, :] - 2 * (q @ r.T), 0.0)
    q = q / (np.linalg.norm(q, axis=1, keepdims=True) + EPSILON)
    if not pre_normalized:
        r = r / (np.linalg.norm(r, axis=1, keepdims=True) + EPSILON)
    return 1.0 - q @ r.T


def common_dim(vectors: DataFrame, embedding: str = "embedding") -> int:
    """The most frequent length of the finite vectors, the larger of equally frequent ones; 0 if there is none."""
    sizes = vectors.where(finite(F.col(embedding))).groupBy(F.size(embedding).alias("dim")).count()
    first = sizes.orderBy(F.desc("count"), F.desc("dim")).first()
    return first["dim"] if first else 0


def usable(vectors: DataFrame, embedding: str = "embedding", dim: int | None = None) -> DataFrame:
    """Rows whose vector is not null, finite and of length ``dim`` (by default the most frequent one)."""
    if dim is None:
        dim = common_dim(vectors, embedding)
    return vectors.where(finite(F.col(embedding), dim))


def _blocks(queries: DataFrame, refs: DataFrame, size: int) -> tuple[int, int]:
    nq, nr = queries.count(), refs.count()
    a = max(1, math.ceil(nq / size))
    slots = int(queries.sparkSession.sparkContext.defaultParallelism)
    return a, max(1, math.ceil(nr / REF_BLOCK), min(math.ceil(slots / a), math.ceil(nr / 1024)))


def _meeting(queries: DataFrame, refs: DataFrame, size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides with (_qb, _rb): each query block, of ``size`` rows, is sent to all reference blocks and the other way round."""
    a, b = _blocks(queries, refs, size or QUERY_BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("_qb", F.pmod(F.xxhash64("query_pos"), F.lit(a)).cast("int")).withColumn("_rb", every(b))
    r = refs.withColumn("_rb", F.pmod(F.xxhash64("ref_pos"), F.lit(b)).cast("int")).withColumn("_qb", every(a))
    return q, r


def _slabs(queries: int, refs: int) -> list[slice]:
    """Parts of a block's queries whose pairs with its references are at most ``SLAB_PAIRS``, or those of one query."""
    step = max(1, SLAB_PAIRS // max(refs, 1))
    return [slice(lo, min(lo + step, queries)) for lo in range(0, queries, step)]


def _scaled(r: np.ndarray, metric: str, pre_normalized: bool) -> np.ndarray:
    """References of a block as ``matrix_distance`` takes them with ``pre_normalized``, so that its slabs need not repeat it."""
    return r / (np.linalg.norm(r, axis=1, keepdims=True) + EPSILON) if metric == "cosine" and not pre_normalized else r


def _stack(vectors: pa.ChunkedArray) -> np.ndarray:
    n = len(vectors)
    return vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64) if n else np.zeros((0, 1))


def _best(near: np.ndarray, refs: np.ndarray, names: np.ndarray | None, k: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, reference, distance) of one slab: all, or the best ``k`` of each row by (distance, reference).

    With ``names`` every name counts once, at its closest reference; the columns are in order of (name, reference) then.
    """
    starts = None
    if names is not None:
        starts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        columns, near = near, np.minimum.reduceat(near, starts, axis=1)
    if k is None or k >= near.shape[1]:
        rows, cols = np.nonzero(np.ones_like(near, bool))
    else:
        # The k-th distance bounds what can be among the best; ties stay in until they are ordered.
        rows, cols = np.nonzero(~(near > np.partition(near, k - 1, axis=1)[:, k - 1 : k]))
    value = near[rows, cols]
    if starts is None:
        at = refs[cols]
    else:
        ends = np.append(starts[1:], len(refs))
        at = np.array([refs[starts[c] + np.argmin(columns[i, starts[c] : ends[c]])] for i, c in zip(rows, cols)], "i8")
    order = np.lexsort((at, value, rows))
    rows, at, value = rows[order], at[order], value[order]
    if k is not None:
        first = np.searchsorted(rows, np.arange(len(near)))
        keep = np.arange(len(rows)) - first[rows] < k
        rows, at, value = rows[keep], at[keep], value[keep]
    return rows, at, value


def _direct(q: np.ndarray, r: np.ndarray, near: np.ndarray | None, k: int | None) -> np.ndarray:
    """Squared distances of a slab as sums of squared differences, where they can be among the ``k`` least (None: all).

    The product form ``near`` loses digits where vectors are long and near; its
    error is within the slack. Where all are wanted it is not read.
    """
    if k is None or k >= len(r):
        out, step, ones = np.empty((len(q), len(r))), max(1, 32_768 // max(r.shape[1], 1)), np.ones(r.shape[1])
        for lo in range(0, len(r), step):
            some = r[lo : lo + step]
            gap = np.empty_like(some)
            for i, one in enumerate(q):
                np.subtract(one, some, out=gap)
                np.multiply(gap, gap, out=gap)
                np.matmul(gap, ones, out=out[i, lo : lo + step])
        return out
    near = near.copy()
    slack = 64 * np.finfo("f8").eps * ((q * q).sum(1) + (r * r).sum(1).max())
    rows, cols = np.nonzero(near <= np.partition(near, k - 1, axis=1)[:, k - 1 : k] + slack[:, None])
    for lo in range(0, len(rows), 1 << 20):
        i, j = rows[lo : lo + (1 << 20)], cols[lo : lo + (1 << 20)]
        near[i, j] = ((q[i] - r[j]) ** 2).sum(1)
    return near


def _met(q: DataFrame, r: DataFrame, keys: list[str], k: int | None, metric: str, threshold: float | None, pre_normalized: bool, dedupe: bool) -> DataFrame:
    """Candidates of the blocks that share ``keys``; with ``k`` only the best k of each query and bank."""
    arrow = to_arrow_schema(NEIGHBORS)

    def meet(q: pa.Table, r: pa.Table) -> pa.Table:
        if not (q.num_rows and r.num_rows):
            return arrow.empty_table()
        if dedupe:  # the rows of an accession stand together, for the slabs
            names = np.unique(r["ref_accession"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)[1]
            order = np.lexsort((r["ref_pos"].to_numpy(), names))
            r, names = r.take(pa.array(order)), names[order]
        asks, all_refs = _stack(q["embedding"]), _scaled(_stack(r["embedding"]), metric, pre_normalized)
        qp, rp, banks, parts = q["query_pos"].to_numpy(), r["ref_pos"].to_numpy(), r["banks"].to_pylist(), []
        for bank in sorted({b for own in banks for b in own}):
            own = np.array([bank in x for x in banks])
            refs, at_refs, own_names = all_refs[own], rp[own], names[own] if dedupe else None
            for part in _slabs(len(asks), len(refs)):
                near = matrix_distance(asks[part], refs, metric, True)
                if metric == "l2":
                    near = _direct(asks[part], refs, near, None if dedupe else k)
                rows, at, value = _best(np.round(near, DECIMALS, out=near), at_refs, own_names, k)
                if threshold is not None:
                    fine = value <= threshold
                    rows, at, value = rows[fine], at[fine], value[fine]
                parts.append(pa.table({"aspect_key": pa.array([bank] * len(rows), "string"), "query_pos": qp[part][rows], "ref_pos": at, "distance": value}, schema=arrow))
        return pa.concat_tables(parts) if parts else arrow.empty_table()

    q, r = q.select(*keys, "query_pos", "embedding"), r.select(*keys, "ref_pos", "ref_accession", "embedding", "banks")
    return q.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInArrow(meet, NEIGHBORS)


def _block_pairs(queries: DataFrame, refs: DataFrame, k: int | None, metric: str, threshold: float | None, pre_normalized: bool, dedupe: bool = False) -> DataFrame:
    """Candidates of every query block against every reference block."""
    return _met(*_meeting(queries, refs), ["_qb", "_rb"], k, metric, threshold, pre_normalized, dedupe)


def _all_pairs(queries: DataFrame, refs: DataFrame, metric: str) -> DataFrame:
    """(query_pos, ref_pos, distance) of every pair; a task gives out a slab at a time, never the pairs of a block at once."""
    schema = T.StructType([f for f in NEIGHBORS if f.name != "aspect_key"])
    names = schema.names

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pa.Table.from_batches(batches)
        q, r = both.filter(both["asks"]), both.filter(pc.invert(both["asks"]))
        if not (q.num_rows and r.num_rows):
            return
        asks, own = _stack(q["embedding"]), _scaled(_stack(r["embedding"]), metric, False)
        qp, rp = q["pos"].to_numpy(), r["pos"].to_numpy()
        for part in _slabs(len(asks), len(own)):
            d = np.round(_direct(asks[part], own, None, None) if metric == "l2" else matrix_distance(asks[part], own, metric, True), DECIMALS)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qp[part], len(rp))), pa.array(np.tile(rp, len(d))), pa.array(d.ravel())], names)

    q, r = _meeting(queries, refs, FULL_QUERY_BLOCK)
    side = lambda df, asks, pos: df.select("_qb", "_rb", F.lit(asks).alias("asks"), F.col(pos).cast("long").alias("pos"), doubles("embedding").alias("embedding"))
    return side(q, True, "query_pos").unionByName(side(r, False, "ref_pos")).groupBy("_qb", "_rb").applyInArrow(meet, schema)


def _rankings(queries: DataFrame, refs: DataFrame, k: int, metric: str, threshold: float | None, pre_normalized: bool, dedupe: bool, count: int) -> DataFrame:
    """The result of ``knn_join`` where a ranking holds (nearly) all references: no pair is moved or sorted outside the task that made it."""
    spark, out = queries.sparkSession, [("aspect_key", "string"), ("query_pos", "long"), ("protein_accession", "string"), ("k_position", "int"), ("ref_pos", "long"), ("ref_accession", "string"), ("distance", "double")]
    slots = int(spark.sparkContext.defaultParallelism)
    parts = slots * max(1, math.ceil(queries.count() * count / (slots * WHOLE_PAIRS)))
    # Keys that hash partitioning sends to one partition each.
    own = F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("part")
    keys = F.array(*[F.lit(x["id"]).cast("int") for x in spark.range(64 * parts).groupBy(own).agg(F.min("id").alias("id")).collect()])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pa.Table.from_batches(batches)
        q, r = both.filter(both["asks"]), both.filter(pc.invert(both["asks"]))
        del both
        if not (q.num_rows and r.num_rows):
            return
        labels = np.unique(r["name"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)[1] if dedupe else np.zeros(r.num_rows, int)
        order = np.lexsort((r["pos"].to_numpy(), labels))
        r, labels = r.take(pa.array(order)), labels[order]
        asks, all_refs = _stack(q["embedding"]), _scaled(_stack(r["embedding"]), metric, pre_normalized)
        qp, rp, banks = q["pos"].to_numpy(), r["pos"].to_numpy(), r["banks"].to_pylist()
        q_names, r_names = q["name"].combine_chunks(), r["name"].combine_chunks()
        for bank in sorted({b for x in banks for b in x}):
            mine = np.flatnonzero([bank in x for x in banks])
            near_refs = all_refs if len(mine) == len(banks) else all_refs[mine]
            for part in _slabs(len(asks), len(mine)):
                near = np.round(_direct(asks[part], near_refs, None, None) if metric == "l2" else matrix_distance(asks[part], near_refs, metric, True), DECIMALS)
                if dedupe:
                    rows, at, value = _best(near, rp[mine], labels[mine], k)
                    by = np.argsort(rp[mine])
                    cols = mine[by[np.searchsorted(rp[mine], at, sorter=by)]]
                else:  # the references are in order of ref_pos, so that a stable sort settles ties
                    cols = np.argsort(near, axis=1, kind="stable")[:, :k]
                    rows, value = np.repeat(np.arange(len(near)), cols.shape[1]), np.take_along_axis(near, cols, 1).ravel()
                    cols = mine[cols.ravel()]
                if threshold is not None:
                    fine = value <= threshold
                    rows, cols, value = rows[fine], cols[fine], value[fine]
                position = np.arange(len(rows)) - np.searchsorted(rows, np.arange(len(near)))[rows] + 1
                rows = rows + part.start
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bank], "string").take(pa.array(np.zeros(len(rows), "i4"))), pa.array(qp[rows]), q_names.take(pa.array(rows)), pa.array(position.astype("i4")), pa.array(rp[cols]), r_names.take(pa.array(cols)), pa.array(value)], [n for n, _ in out]
                )

    side = lambda df, key, asks, pos, name, banks: df.select(key.alias("_qb"), F.lit(asks).alias("asks"), F.col(pos).cast("long").alias("pos"), F.col(name).cast("string").alias("name"), "embedding", banks.cast("array<string>").alias("banks"))
    q = side(queries, F.element_at(keys, F.pmod(F.xxhash64("query_pos"), F.lit(parts)).cast("int") + 1), True, "query_pos", "protein_accession", F.array())
    r = side(refs, F.explode(keys), False, "ref_pos", "ref_accession", F.col("banks"))
    return q.unionByName(r).repartition(parts, "_qb").groupBy("_qb").applyInArrow(rank, ", ".join(f"{n} {t}" for n, t in out))


def _jvm_dot(dim: int) -> Column:
    """Inner product of the columns of ``_jvm_sides``; it is written out, as array lambdas are never compiled, in the order of ``dot``."""
    if dim > WRITTEN_DIM:
        return dot("q", "r")
    total = F.lit(0.0)
    for i in range(dim):
        total = total + F.col(f"q{i}") * F.col(f"r{i}")
    return total


def _jvm_sides(queries: DataFrame, refs: DataFrame, metric: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with their vectors, single numbers of them and their sizes; a reference once for each of its banks."""
    fields = dim if dim <= WRITTEN_DIM else 0
    sized = dot("x", "x") if metric == "l2" else norm("x") + EPSILON

    def side(df: DataFrame, name: str, count: int, *more: str) -> DataFrame:
        # Without nulls each product takes half the code.
        x = df.withColumn("x", F.coalesce(F.transform("embedding", lambda v: F.coalesce(v.cast("double"), F.lit(0.0))), F.array(F.lit(0.0))))
        parts = [F.coalesce(F.get("x", F.lit(i)), F.lit(0.0)).alias(f"{name}{i}") for i in range(count)]
        return x.select(*more, F.coalesce(sized, F.lit(0.0)).alias(f"{name}_size"), F.col("x").alias(name), *parts)

    r = side(refs, "r", fields, "ref_pos", "banks").withColumn("aspect_key", F.explode("banks")).drop("banks")
    return side(queries, "q", fields, "query_pos"), r


def _jvm_pairs(queries: DataFrame, refs: DataFrame, k: int, metric: str, pre_normalized: bool, dedupe: bool, dim: int) -> DataFrame:
    """Pairs that hold the best ``k`` of each query and bank, without Python.

    The ranking of a query in a sample of the references bounds its ranking in
    all of them, so that only some ``sqrt(k * references)`` pairs of a query
    are ordered in either step. Where the sample has no ``k`` references of a
    bank, all pairs of that query and bank are given out.
    """
    keys, over = ["_qb", "_rb"], F.col("q_size") if pre_normalized else F.col("q_size") * F.col("r_size")
    exact = squared_l2("q", "r") if metric == "l2" else 1 - dot("q", "r") / over
    fast = exact if metric == "l2" else 1 - _jvm_dot(dim) / over
    nq, nr = queries.count(), refs.count()
    sample = 2 * math.ceil(math.sqrt(k * nr))
    q, r = _jvm_sides(queries, refs, metric, dim)
    if nq * nr <= JVM_PAIRS or sample >= nr:
        q, r = _meeting(q, r)
        return q.join(r, keys).select("aspect_key", "query_pos", "ref_pos", F.round(fast, DECIMALS).alias("distance"))
    drawn = F.pmod(F.xxhash64("ref_pos", F.lit(7)), F.lit(nr)) < sample
    some_q, some_r = _meeting(q, r.where(drawn))
    some = some_q.join(some_r, keys).select("aspect_key", "query_pos", "ref_pos", F.round(fast, DECIMALS).alias("distance"))
    last = _ranked(some, refs, k, dedupe).where(F.col("k_position") == k)
    last = cut(last.select("aspect_key", "query_pos", F.col("distance").alias("last"), F.col("ref_pos").alias("last_ref")), "bounds")
    banks = [x["aspect_key"] for x in r.select("aspect_key").distinct().collect()]
    q = q.withColumn("aspect_key", F.explode(F.array(*map(F.lit, banks)))).join(last, ["aspect_key", "query_pos"], "left")
    q = q.withColumns({"last": F.coalesce("last", F.lit(math.inf)), "last_ref": F.coalesce("last_ref", F.lit(2**63 - 1))})
    q, r = _meeting(q, r, JVM_QUERY_BLOCK)
    # Blocks are small for what they cost, so they are not left to be joined up by size.
    parts = 4 * len(banks) * math.prod(_blocks(queries, refs, JVM_QUERY_BLOCK))
    q = q.withColumnRenamed("aspect_key", "bank").repartition(parts, "_qb", "_rb", "bank")
    r = r.withColumnRenamed("_qb", "qb").withColumnRenamed("_rb", "rb").repartition(parts, "qb", "rb", "aspect_key")
    # Rounding and sums of squared differences, which are dear, are left to what the slack lets through; of equal distances
    # only those up to the bound's reference. A later filter would be pushed into the join and keep it from being compiled.
    slack = F.when(F.col("ref_pos") <= F.col("last_ref"), 2e-12).otherwise(-0.4e-12)
    if metric == "l2":
        both = F.col("q_size") + F.col("r_size")
        near = both - 2 * _jvm_dot(dim) <= F.col("last") + slack + F.col("last") * 1e-12 + both * (max(dim, 64) * 1e-15)
    else:
        near = fast <= F.col("last") + slack
    met = q.join(r, (F.col("_qb") == F.col("qb")) & (F.col("_rb") == F.col("rb")) & (F.col("bank") == F.col("aspect_key")) & near)
    return met.select("aspect_key", "query_pos", "ref_pos", F.round(exact, DECIMALS).alias("distance"))


def _ranked(pairs: DataFrame, refs: DataFrame, k: int, dedupe: bool) -> DataFrame:
    """The best ``k`` of each query and bank, with ``k_position``."""
    if dedupe:
        pairs = pairs.join(refs.select("ref_pos", "ref_accession"), "ref_pos").groupBy("aspect_key", "query_pos", "ref_accession").agg(F.min(F.struct("distance", "ref_pos")).alias("d")).select("aspect_key", "query_pos", "d.distance", "d.ref_pos")
    order = [F.col("distance"), F.col("ref_pos")]
    return pairs.withColumn("k_position", F.row_number().over(Window.partitionBy("aspect_key", "query_pos").orderBy(*order))).where(F.col("k_position") <= k)


def _placed(vectors: DataFrame, cells: Callable[[np.ndarray], list[np.ndarray]]) -> DataFrame:
    """``vectors`` once per row and cell that ``cells`` names for its block of embeddings, with the column ``cell``."""
    schema = T.StructType([*vectors.schema.fields, T.StructField("cell", T.LongType())])
    arrow = to_arrow_schema(schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
                for own in cells(x):
                    yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, arrow)), pa.array(own, "i8")], schema=arrow)

    return vectors.mapInArrow(place, schema)


def _counted(vectors: DataFrame, cells: Callable[[np.ndarray], list[np.ndarray]], size: int, name: str) -> DataFrame:
    """(cell, blocks of ``size`` rows under ``name``); only cell numbers and counts leave the workers."""
    schema = T.StructType([T.StructField("cell", T.LongType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
                own, n = np.unique(np.concatenate(cells(x)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own, "i8"), pa.array(n, "i8")], schema=to_arrow_schema(schema))

    return vectors.select("embedding").mapInArrow(count, schema).groupBy("cell").agg(F.ceil(F.sum("n") / size).cast("int").alias(name))


def _within_cells(queries: DataFrame, refs: DataFrame, of_query: Callable, of_ref: Callable, how: tuple) -> DataFrame:
    """Best candidates among the pairs that share a cell.

    A cell with many rows is cut into blocks like the whole table is, so no
    task ever holds a cell. The number of cells is a parameter, so the table of
    their blocks is small.
    """
    queries, refs = queries.select("query_pos", "embedding"), refs.select("ref_pos", "ref_accession", "embedding", "banks")
    blocks = F.broadcast(cut(_counted(queries, of_query, QUERY_BLOCK, "_a").join(_counted(refs, of_ref, REF_BLOCK, "_b"), "cell"), "cell-blocks"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = _placed(queries, of_query).join(blocks, "cell").withColumn("_qb", F.pmod(F.xxhash64("query_pos"), "_a").cast("int")).withColumn("_rb", every("_b"))
    r = _placed(refs, of_ref).join(blocks, "cell").withColumn("_rb", F.pmod(F.xxhash64("ref_pos"), "_b").cast("int")).withColumn("_qb", every("_a"))
    return _met(q, r, ["cell", "_qb", "_rb"], *how)


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    """Centres of Lloyd's algorithm from ``k`` random rows; a centre without rows starts again at a random one."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].astype(np.float64)
    for _ in range(rounds):
        own = np.concatenate([np.argmin(matrix_distance(x[lo : lo + 8192], centres, "l2"), axis=1) for lo in range(0, len(x), 8192)])
        count, total = np.bincount(own, minlength=k), np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], x[rng.integers(len(x), size=k)])
    return centres


def _cell_pairs(queries: DataFrame, refs: DataFrame, how: tuple, metric: str, nlist: int, nprobe: int, seed: int, sample: int) -> DataFrame:
    """Inverted lists: cells by k-means on about ``sample`` references; a query meets its ``nprobe`` nearest cells, a reference is in one."""

    def scaled(x: np.ndarray) -> np.ndarray:
        return x / (np.linalg.norm(x, axis=1, keepdims=True) + EPSILON) if metric == "cosine" else x

    total = refs.count()
    if not total:
        return queries.sparkSession.createDataFrame([], NEIGHBORS)
    share = min(1.0, sample / total)
    bound = F.lit(min(int((2 * share - 1) * 2**63), 2**63 - 1))
    fit = refs.where(F.xxhash64("ref_pos", F.lit(seed)) <= bound).select("embedding").toArrow()
    if not fit.num_rows:
        fit = refs.select("embedding").limit(1).toArrow()
    centres = kmeans(scaled(_stack(fit["embedding"])), max(1, min(nlist, fit.num_rows)), seed)

    def nearest(count: int) -> Callable[[np.ndarray], list[np.ndarray]]:
        count = min(count, len(centres))

        def cells(x: np.ndarray) -> list[np.ndarray]:
            far = matrix_distance(scaled(x), centres, "l2")
            best = np.argpartition(far, count - 1, axis=1)[:, :count] if count < len(centres) else np.tile(np.arange(count), (len(x), 1))
            return list(best.T)

        return cells

    return _within_cells(queries, refs, nearest(nprobe), nearest(1), how)


def _hash_pairs(queries: DataFrame, refs: DataFrame, how: tuple, tables: int, bits: int, seed: int, dim: int) -> DataFrame:
    """Random hyperplane hashes: a query meets the references that share its bucket in any table."""
    planes = np.random.default_rng(seed).normal(size=(tables, max(dim, 1), bits))
    weights = 1 << np.arange(bits)

    def buckets(x: np.ndarray) -> list[np.ndarray]:
        return [((x @ p > 0) @ weights) + (i << bits) for i, p in enumerate(planes)]

    # A pair can meet in several tables.
    return _within_cells(queries, refs, buckets, buckets, how).distinct()


def distance_matrix(queries: DataFrame, refs: DataFrame, metric: str = "cosine", dim: int | None = None) -> DataFrame:
    """(query_pos, ref_pos, distance) of all usable pairs: what the ranked join ranks."""
    check_metric(metric)
    if dim is None:
        dim = common_dim(refs)
    return _all_pairs(usable(queries, dim=dim), usable(refs, dim=dim), metric)


def refs_by_aspect(refs: DataFrame, annotations: DataFrame, terms: DataFrame) -> DataFrame:
    """(ref_pos, aspect) of the references with at least one annotation in an aspect F, P or C."""
    aspects = annotations.join(terms.where(F.col("aspect").isin(*ASPECT_CODES)).select("go_term_id", "aspect"), "go_term_id").select("ref_accession", "aspect").distinct()
    return refs.select("ref_pos", "ref_accession").join(aspects, "ref_accession").select("ref_pos", "aspect")


def knn_join(
    queries: DataFrame, refs: DataFrame, k: int = 5, metric: str = "cosine", distance_threshold: float | None = None, strategy: str = "auto",
    pre_normalized: bool = False, dedupe: bool = False, banks: DataFrame | None = None, dim: int | None = None,
    nlist: int = 100, nprobe: int = 8, tables: int = 12, bits: int = 8, seed: int = 42, sample: int = 25_600,
) -> DataFrame:
    """The ``k`` nearest references of every query.

    ``queries`` (query_pos, protein_accession, embedding) and ``refs`` (ref_pos,
    ref_accession, embedding); unusable vectors take no part, zero vectors have
    cosine distance 1. With ``banks`` (ref_pos, aspect) one ranking is made per
    aspect over its references, else one over all under the key ``""``.
    ``distance_threshold`` keeps distances up to it, included; ``dedupe`` ranks
    every accession once, at its closest row. k beyond the number of references
    gives them all, k = 0 none. Strategies: ``block`` (matrix products in Arrow
    workers), ``jvm`` (array expressions, no Python), ``ivf`` and ``lsh``
    (approximate); ``auto`` takes ``jvm`` for small sides, else ``block``.
    """
    check_metric(metric)
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; one of {', '.join(STRATEGIES)}")
    if k < 0:
        raise ValueError("k must not be negative")
    if dim is None:
        dim = common_dim(refs)
    q, r = usable(queries, dim=dim), usable(refs, dim=dim)
    if banks is None:
        r = r.withColumn("banks", F.array(F.lit("")))
    else:
        r = r.join(banks.groupBy("ref_pos").agg(F.collect_set("aspect").alias("banks")), "ref_pos")
    if strategy == "auto":
        strategy = "jvm" if queries.count() * refs.count() <= JVM_PAIRS else "block"
    how = (k, metric, distance_threshold, pre_normalized, dedupe)
    if k and strategy == "block" and (count := r.count()) and k >= min(count, WHOLE_K) and count * dim * 8 <= WHOLE_BYTES:
        return _rankings(q, r, *how, count)
    if not k:
        pairs = q.sparkSession.createDataFrame([], NEIGHBORS)
    elif strategy == "block":
        pairs = _block_pairs(q, r, *how)
    elif strategy == "jvm":
        pairs = _jvm_pairs(q, r, k, metric, pre_normalized, dedupe, dim)
    elif strategy == "ivf":
        pairs = _cell_pairs(q, r, how, metric, nlist, nprobe, seed, sample)
    else:
        pairs = _hash_pairs(q, r, how, tables, bits, seed, dim)
    if distance_threshold is not None:  # keeps a prefix of every ranking, so it may go below it
        pairs = pairs.where(F.col("distance") <= distance_threshold)
    ranked = _ranked(pairs, refs, k, dedupe)
    return (
        ranked.join(refs.select("ref_pos", "ref_accession"), "ref_pos")
        .join(queries.select("query_pos", "protein_accession"), "query_pos")
        .select("aspect_key", "query_pos", "protein_accession", "k_position", "ref_pos", "ref_accession", "distance")
    )


def written(neighbors: DataFrame) -> DataFrame:
    """Neighbours as a written table, for plans that read them several times."""
    return cut(neighbors, "neighbors")
