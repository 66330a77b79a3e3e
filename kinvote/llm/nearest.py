"""Most similar vectors by several shifted Hilbert orderings.

Unit vectors are projected onto a few random orthogonal directions, shifted at
random and numbered along a Hilbert curve; this is done for several curves. On
each curve the references and queries are sorted together by range, and a query
takes the references in the window of neighbouring keys around its place. The
windows of all curves are merged and ranked by one-byte vectors, and all vectors
of the best few accessions that may be their closest are ranked again with the original numbers. Windows that reach
over the end of a partition are completed from the nearest references before and
after it, from as many partitions as that takes. Queries for which the curves do not give enough are searched
once more, exactly, in blocks of queries and references.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kinvote.functions.vectors import dot, doubles, finite
from kinvote.llm.ranges import partitions
from kinvote.sources.scratch import cut

_CODES = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("twin", T.LongType()), T.StructField("code", T.BinaryType())])
_KEYS = T.StructType(
    [T.StructField("curve", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("fine", T.LongType()), T.StructField("query", T.BooleanType()), T.StructField("id", T.LongType()), T.StructField("owner", T.LongType()), T.StructField("code", T.BinaryType())]
)
_HITS = T.StructType(
    [T.StructField("query_id", T.LongType()), T.StructField("ref_id", T.LongType()), T.StructField("owner", T.LongType()), T.StructField("similarity", T.FloatType()), T.StructField("edge", T.StringType()), T.StructField("place", T.LongType()), T.StructField("code", T.BinaryType())]
)
_PAIRS = T.StructType(_HITS.fields[:4])
_MET = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("ref_id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("distance", T.DoubleType())])

#: Rows of a sorted partition on average at most.
TASK_ROWS = 400_000
#: Queries of one vector that a task answers on average at most.
TWINS = 100_000
#: Error of a one-byte similarity: the part that grows with the distance of the vectors, and the constant one.
CODE_ERROR = (0.004, 4e-5)
#: Rows of a block of the exact search at most, and of its queries that are multiplied at a time.
QUERY_BLOCK, REF_BLOCK, STEP = 2048, 8192, 256


@dataclass(frozen=True)
class Curves:
    """Projections, shifts and grids of the orderings, fitted on a bounded sample.

    ``sample`` is the most rows that the grid's centre and widths are taken
    from; every vector is indexed. ``window`` counts the references on either
    side, ``keep`` the accessions of one window and ``final`` those of a query
    that are ranked exactly, each by its best vector. A query one of whose
    nearest accessions was seen on fewer than ``agree`` curves is in doubt:
    where one curve alone finds a neighbour, others are likely missed by all.
    """

    dim: int = 64
    count: int = 16
    axes: int = 10
    bits: int = 6
    window: int = 32
    keep: int = 12
    final: int = 20
    agree: int = 2
    seed: int = 7
    sample: int = 10_000
    centre: np.ndarray = field(default=None, repr=False)
    width: np.ndarray = field(default=None, repr=False)

    def projections(self) -> list[np.ndarray]:
        """One (dim, axes) matrix per curve: disjoint columns of random rotations."""
        rng, out = np.random.default_rng(self.seed), []
        axes = min(self.axes, self.dim)
        while len(out) < self.count:
            turn = np.linalg.qr(rng.normal(size=(self.dim, self.dim)))[0]
            out.extend(turn[:, i : i + axes] for i in range(0, self.dim - axes + 1, axes))
        return out[: self.count]

    def fitted(self, unit: np.ndarray) -> Curves:
        """With centre and widths of a sample of unit vectors."""
        if not len(unit):
            unit = np.zeros((1, self.dim))
        centre = unit.mean(0)
        width = np.stack([np.maximum(((unit - centre) @ p).std(0), 1e-6) for p in self.projections()])
        return Curves(self.dim, self.count, self.axes, self.bits, self.window, self.keep, self.final, self.agree, self.seed, self.sample, centre, width)

    def keys(self, unit: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per curve the Hilbert numbers of unit vectors and those of a finer grid inside the cells: half the grid is room for the shift."""
        shift = np.random.default_rng(self.seed + 1).uniform(0, 0.5, (self.count, min(self.axes, self.dim)))
        top, out = (1 << 2 * self.bits) - 1, []
        for p, width, by in zip(self.projections(), self.width, shift):
            spread = ((unit - self.centre) @ p) / width
            cells = np.clip(((spread + 4) / 16 + by) * (top + 1), 0, top).astype(np.int64)
            x = _transposed(cells, 2 * self.bits)
            out.append((_packed(x >> self.bits, self.bits), _packed(x & ((1 << self.bits) - 1), self.bits)))
        return out


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions of grid cells (n, axes) on the Hilbert curve with ``bits`` bits per axis; axes * bits must be below 64."""
    return _packed(_transposed(cells, bits), bits)


def _transposed(cells: np.ndarray, bits: int) -> np.ndarray:
    """The published transform of axes to a transposed index by J. Skilling (2004), worked on all rows at once."""
    x = np.ascontiguousarray(cells.T)
    axes = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(axes):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap if i else 0
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    return x ^ flip


def _packed(x: np.ndarray, bits: int) -> np.ndarray:
    """The ``bits`` lowest bits of a transposed index as one number."""
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(len(x)):
            key = key << 1 | x[i] >> level & 1
    return key


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A binary column whose values all have ``width`` bytes."""
    if not len(column):
        return np.zeros((0, width), np.int8)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.int8)[offsets[0] : offsets[-1]].reshape(len(column), width)


def _binary(rows: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(rows)
    ends = np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(ends), pa.py_buffer(flat)])


def _units(codes: np.ndarray) -> np.ndarray:
    out = codes.astype(np.float32)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def coded(vectors: DataFrame, identifier: str, name: str | None, embedding: str, dim: int) -> DataFrame:
    """(id, name, twin, code) of the usable vectors: ``code`` has one byte per number, the largest at 127, ``twin`` is a hash of the numbers.

    Usable are vectors of ``dim`` finite numbers that are not all zero, with an id.
    """
    arrow = to_arrow_schema(_CODES)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim).astype(np.float64)
            x = np.rint(x / np.abs(x).max(axis=1, keepdims=True) * 127).astype(np.int8)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("name"), batch.column("twin"), _binary(x)], schema=arrow)

    v = F.col(embedding)
    rows = vectors.where(finite(v, dim) & F.col(identifier).isNotNull() & F.exists(v, lambda x: x != 0))
    label = F.col(name).cast("string") if name else F.lit(None).cast("string")
    return rows.select(F.col(identifier).cast("long").alias("id"), label.alias("name"), F.xxhash64(v).alias("twin"), v.alias("v")).mapInArrow(code, _CODES)


def _keyed(codes: DataFrame, curves: Curves, query: bool) -> DataFrame:
    """One row per vector and curve with its key on the curve."""
    arrow = to_arrow_schema(_KEYS)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            for curve, (keys, fine) in enumerate(curves.keys(_units(_matrix(batch.column("code"), curves.dim)))):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, curve, "i4")), pa.array(keys), pa.array(fine), pa.array(np.full(n, query)), batch.column("id"), batch.column("owner"), batch.column("code")], schema=arrow)

    return codes.mapInArrow(key, _KEYS)


def code_error(similarity):
    """How far apart two one-byte similarities near ``similarity`` can be although the true ones are equal."""
    return CODE_ERROR[0] * np.sqrt(np.maximum(2 - 2 * similarity, 0)) + CODE_ERROR[1]


def _leading(near: np.ndarray, owners: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``keep`` most similar owners of each row: their best columns and those that one-byte numbers cannot tell from these."""
    order = np.argsort(-near, axis=1, kind="stable")
    owners = np.take_along_axis(owners, order, 1)
    by = np.argsort(owners, axis=1, kind="stable")  # owner by owner, the best column first
    own = np.take_along_axis(owners, by, 1)
    first = np.concatenate([np.ones((len(own), 1), bool), own[:, 1:] != own[:, :-1]], axis=1)
    fresh = np.empty(near.shape, bool)
    np.put_along_axis(fresh, by, first, 1)
    start = np.maximum.accumulate(np.where(first, np.arange(near.shape[1]), 0), axis=1)
    place = np.take_along_axis(np.take_along_axis(np.cumsum(fresh, axis=1), by, 1), start, 1)
    value = np.take_along_axis(np.take_along_axis(near, order, 1), by, 1)
    best = np.take_along_axis(value, start, 1)
    rows, cols = np.nonzero((place <= keep) & (first | (value >= best - code_error(best))))
    return rows, order[rows, by[rows, cols]]


def _windows(refs: np.ndarray, owners: np.ndarray, queries: np.ndarray, at: np.ndarray, curves: Curves) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query index, reference index, similarity) of the best owners of each window; ``at`` counts the references before a query."""
    n, w = len(refs), curves.window
    if not n:
        return
    span = min(2 * w, n)
    units = _units(refs)
    for lo in range(0, len(queries), 512):
        part = _units(queries[lo : lo + 512])
        first = np.clip(at[lo : lo + 512] - w, 0, n - span)
        index = first[:, None] + np.arange(span)
        near = np.einsum("qwd,qd->qw", units[index], part)
        rows, cols = _leading(near, owners[index], curves.keep)
        yield rows + lo, index[rows, cols], near[rows, cols]


def _hits(batches: Iterator[pa.RecordBatch], curves: Curves) -> Iterator[pa.RecordBatch]:
    """Candidates of one sorted partition, and what it gives to the boundaries on either side."""
    from pyspark import TaskContext

    pid, arrow, w = TaskContext.get().partitionId(), to_arrow_schema(_HITS), curves.window
    table = pa.Table.from_batches(list(batches), schema=to_arrow_schema(_KEYS)).combine_chunks()
    if not table.num_rows:
        return
    curve, query, ids = (table[c].to_numpy() for c in ("curve", "query", "id"))
    owners = table["owner"].to_numpy()
    codes = _matrix(table["code"].chunk(0), curves.dim)
    runs = np.flatnonzero(np.diff(curve, prepend=curve[0] - 1))
    for k, lo in enumerate(runs):
        hi = runs[k + 1] if k + 1 < len(runs) else len(curve)
        q, own, owner, code = query[lo:hi], ids[lo:hi], owners[lo:hi], codes[lo:hi]
        before = np.cumsum(~q)
        refs, asks = np.flatnonzero(~q), np.flatnonzero(q)
        at = before[asks]
        for rows, hits, near in _windows(code[refs], owner[refs], code[asks], at, curves):
            n = len(rows)
            yield pa.RecordBatch.from_arrays([pa.array(own[asks][rows]), pa.array(own[refs][hits]), pa.array(owner[refs][hits]), pa.array(near.astype("f4")), pa.nulls(n, "string"), pa.nulls(n, "int64"), pa.nulls(n, "binary")], schema=arrow)
        # Every end of the partition's run gives its last references and the queries that have fewer than a window before (after) them.
        for side, given, open_ in ((-1, refs[:w], asks[at < w]), (1, refs[-w:], asks[len(refs) - at < w])):
            for rows, asked in ((given, False), (open_, True)):
                n = len(rows)
                none = pa.nulls(n, "int64")
                place = [pid, side] if asked else [pid, -side]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[rows]) if asked else none, none if asked else pa.array(own[rows]), pa.array(owner[rows]), pa.nulls(n, "float32"), pa.array([f"{curve[lo]}:{place[0]}:{place[1]}"] * n, "string"), pa.array(rows), _binary(code[rows])], schema=arrow
                )


def _edge(rows: pa.Table, curves: Curves) -> pa.Table:
    """Candidates of the queries at one end of a partition among the references carried to it: one window a side at most."""
    asked = rows["query_id"].is_valid().to_numpy()
    rows = rows.combine_chunks()
    refs, asks = np.flatnonzero(~asked), np.flatnonzero(asked)
    if not (len(refs) and len(asks)):
        return to_arrow_schema(_PAIRS).empty_table()
    codes = _matrix(rows["code"].chunk(0), curves.dim)
    owners, units, parts = rows["owner"].to_numpy()[refs], _units(codes[refs]), []
    for lo in range(0, len(asks), 4096):
        near = _units(codes[asks[lo : lo + 4096]]) @ units.T
        q, r = _leading(near, np.broadcast_to(owners, near.shape), curves.keep)
        parts.append(pa.table({"query_id": rows["query_id"].take(asks[lo + q]), "ref_id": rows["ref_id"].take(refs[r]), "owner": owners[r], "similarity": near[q, r].astype("f4")}, schema=to_arrow_schema(_PAIRS)))
    return pa.concat_tables(parts)


def _carried(counts: list[tuple[str, int]], asking: set[str], window: int) -> list[tuple[str, str, int]]:
    """(source, target, references) that complete the windows at the ends of partitions.

    ``counts`` has the references that each end gives, as "curve:partition:side";
    side 1 asks for what comes after, side -1 for what comes before. What a
    source gives under side -1 are its last references, under 1 its first.
    """
    ends: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for end, n in counts:
        curve, pid, side = map(int, end.split(":"))
        ends.setdefault((curve, side), []).append((pid, n))
    out = []
    for x in ends.values():
        x.sort()
    for target in asking:
        curve, pid, side = map(int, target.split(":"))
        own = ends.get((curve, side), [])
        at, left = (bisect_right(own, (pid, 1 << 60)), window) if side == 1 else (bisect_left(own, (pid, -1)) - 1, window)
        while left > 0 and 0 <= at < len(own):
            source, n = own[at]
            out.append((f"{curve}:{source}:{side}", target, min(n, left)))
            left, at = left - n, at + side
    return out


def candidates(queries: DataFrame, refs: DataFrame, curves: Curves) -> DataFrame:
    """(query_id, ref_id, place, similarity, hits) of the ``final`` best owners by one-byte similarity over all curves, from coded vectors.

    An owner has one ``place``, the ``similarity`` of its best vector and as ``hits`` the number of
    windows that showed that one; its rows are the vectors that may be its closest.
    """
    spark = refs.sparkSession
    sample = refs.orderBy(F.xxhash64("id"), "id").limit(curves.sample).select("code").collect()
    curves = curves.fitted(_units(np.array([np.frombuffer(r["code"], np.int8) for r in sample]).reshape(len(sample), curves.dim)))
    rows = _keyed(refs, curves, False).unionByName(_keyed(queries.withColumn("owner", F.lit(0).cast("long")), curves, True))
    tasks = max(partitions(refs), -(-(refs.count() + queries.count()) * curves.count // TASK_ROWS))
    # Vectors of one place are in another order on every curve, so a window sees other ones each time and its hits tell how many there are.
    order = ["curve", "key", "fine", F.xxhash64("id", "curve"), "query", "id"]
    found = cut(rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(lambda batches: _hits(batches, curves), _HITS), "windows")
    given = found.where("edge is not null and query_id is null")
    asked = found.where("edge is not null and query_id is not null")
    # One row per end of a partition: its number is bounded by the partitions, not by the data.
    plan = _carried([tuple(r) for r in given.groupBy("edge").count().collect()], {r[0] for r in asked.select("edge").distinct().collect()}, curves.window)
    plan = spark.createDataFrame(plan, "source string, target string, refs int")
    nth = Window.partitionBy("edge").orderBy(F.when(F.col("edge").endswith(":-1"), -F.col("place")).otherwise(F.col("place")))
    carried = given.withColumn("_nth", F.row_number().over(nth)).join(F.broadcast(plan), F.col("edge") == F.col("source")).where(F.col("_nth") <= F.col("refs"))
    edges = carried.withColumn("edge", F.col("target")).select(*_HITS.names).unionByName(asked).groupBy("edge").applyInArrow(lambda t: _edge(t, curves), _PAIRS)
    # One exchange by query serves the merging, the best vector of every owner and the ranking.
    merged = found.where("edge is null").select(*_PAIRS.names).unionByName(edges).repartition("query_id")
    merged = merged.groupBy("query_id", "owner", "ref_id").agg(F.max("similarity").alias("similarity"), F.count(F.lit(1)).alias("hits"))
    # A query has at most 2 * window * curves rows here (and as many of boundaries), so its ranking is bounded.
    best = F.max(F.struct("similarity", (-F.col("ref_id")).alias("ref"), "hits")).over(Window.partitionBy("query_id", "owner"))
    merged = merged.withColumn("b", best).where(F.col("similarity") >= F.col("b.similarity") - _code_error(F.col("b.similarity")))
    rank = Window.partitionBy("query_id").orderBy(F.desc("b.similarity"), F.desc("b.ref"), "owner")
    return merged.withColumn("place", F.dense_rank().over(rank)).where(F.col("place") <= curves.final).select("query_id", "ref_id", "place", "b.similarity", "b.hits")


def _code_error(similarity: Column) -> Column:
    """``code_error`` of a column."""
    return CODE_ERROR[0] * F.sqrt(F.greatest(2 - 2 * similarity, F.lit(0.0))) + CODE_ERROR[1]


def exact(queries: DataFrame, refs: DataFrame, k: int) -> DataFrame:
    """(query_id, ref_id) of the ``k`` nearest accessions by cosine distance, each at its nearest vector; ties go to the smaller accession.

    ``queries`` (query_id, q) and ``refs`` (ref_id, ref_accession, r) with usable
    vectors. Every block of queries meets every block of references
    once and passes on its ``k`` best accessions of a query.
    """
    arrow = to_arrow_schema(_MET)
    a, b = -(-queries.count() // QUERY_BLOCK), -(-refs.count() // REF_BLOCK)
    if not (a and b):
        return queries.sparkSession.createDataFrame([], _MET).select("query_id", "ref_id")

    def unit(vectors: pa.ChunkedArray) -> np.ndarray:
        x = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1).astype(np.float64)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def meet(q: pa.Table, r: pa.Table) -> pa.Table:
        if not (q.num_rows and r.num_rows):
            return arrow.empty_table()
        r = r.sort_by([("ref_accession", "ascending"), ("ref_id", "ascending")])
        names, asked, asks, own = r["ref_accession"].to_numpy(), q["query_id"].to_numpy(), unit(q["q"]), unit(r["r"])
        starts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        ends, ids, parts = np.append(starts[1:], len(names)), r["ref_id"].to_numpy(), []
        for lo in range(0, len(asks), STEP):
            all_far = np.round(1 - asks[lo : lo + STEP] @ own.T, 12)
            far = np.minimum.reduceat(all_far, starts, axis=1)
            # The k-th distance bounds what can be among the best; accessions that tie stay in until they are ordered.
            bound = np.partition(far, k - 1, axis=1)[:, k - 1 : k] if k < far.shape[1] else np.inf
            rows, cols = np.nonzero(far <= bound)
            order = np.lexsort((cols, far[rows, cols], rows))
            rows, cols = rows[order], cols[order]
            fine = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
            rows, cols = rows[fine], cols[fine]
            at = np.array([starts[c] + np.argmin(all_far[i, starts[c] : ends[c]]) for i, c in zip(rows, cols)], "i8")
            parts.append(pa.table({"query_id": asked[lo + rows], "ref_id": ids[at], "name": pa.array(names[at], "string"), "distance": far[rows, cols]}, schema=arrow))
        return pa.concat_tables(parts)

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("_qb", F.pmod(F.xxhash64("query_id"), F.lit(a)).cast("int")).withColumn("_rb", every(b))
    r = refs.withColumn("_rb", F.pmod(F.xxhash64("ref_id"), F.lit(b)).cast("int")).withColumn("_qb", every(a))
    met = q.groupBy("_qb", "_rb").cogroup(r.groupBy("_qb", "_rb")).applyInArrow(meet, _MET)
    # A query has at most k rows of every block here.
    best = met.groupBy("query_id", "name").agg(F.min(F.struct("distance", "ref_id")).alias("b")).select("query_id", "name", "b.*")
    rank = Window.partitionBy("query_id").orderBy("distance", "name")
    return best.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= k).select("query_id", "ref_id")


def most_similar(queries: DataFrame, refs: DataFrame, k: int = 5, curves: Curves | None = None) -> DataFrame:
    """(query_pos, ref_accession, distance, rank) of the ``k`` nearest accessions by cosine distance.

    ``queries`` (query_pos L, embedding) and ``refs`` (ref_pos L, ref_accession
    S, embedding). Vectors that are null, of another length, not finite or all
    zero take no part; references without an accession take no part. An
    accession counts once, at its closest vector; ties go to the smaller
    accession. Copies of one vector under one accession take part once, and
    vectors of one accession that are equal in one-byte numbers are one entry of
    the index, whose vectors are all ranked by their own numbers.
    Queries may repeat the vectors of references. An empty side gives an empty
    result. The search is approximate: a neighbour can be missed if no curve
    puts it within the window (see the README for measured recall). Queries
    that find fewer than ``k`` accessions on the curves, or one of them on
    hardly any curve, or more nearly equal ones than a window passes on, are
    searched exactly.
    """
    curves = curves or Curves()
    one = coded(refs.where(F.col("ref_accession").isNotNull()), "ref_pos", "ref_accession", "embedding", curves.dim).groupBy("name", "code", "twin").agg(F.min("id").alias("id"))
    one = cut(one.select("id", F.xxhash64("name").alias("owner"), "code"), "ref-codes")
    entries = cut(one.groupBy("owner", "code").agg(F.min("id").alias("entry"), F.count(F.lit(1)).alias("n")), "entries")
    coded_refs = entries.select(F.col("entry").alias("id"), "owner", "code")
    others = one.join(entries.where("n > 1"), ["owner", "code"]).where("id <> entry").select(F.col("entry").alias("ref_id"), F.col("id").alias("other"))
    every = cut(coded(queries, "query_pos", None, "embedding", curves.dim).select("id", F.concat_ws(":", "twin", F.xxhash64("code")).alias("name"), "code"), "query-ids")
    # Equal query vectors are searched once, as the least of their ids.
    coded_queries = cut(every.groupBy("name").agg(F.min("id").alias("id"), F.first("code").alias("code"), F.count(F.lit(1)).alias("n")), "query-codes")
    pairs = cut(candidates(coded_queries.select("id", "code"), coded_refs, curves), "pairs")
    # Vectors are moved as they are stored and their lengths beside them; only distances are worked out in doubles.
    length = F.sqrt(dot(doubles("embedding"), doubles("embedding")))
    r = refs.select(F.col("ref_pos").alias("ref_id"), "ref_accession", F.col("embedding").alias("r"), length.alias("r_length"))
    q = queries.select(F.col("query_pos").alias("query_id"), F.col("embedding").alias("q"), length.alias("q_length"))
    enough = min(k, coded_refs.select("owner").distinct().limit(k).count())
    sure = pairs.where(F.col("place") <= enough).groupBy("query_id").agg(F.max("place").alias("n"), F.min("hits").alias("hits"), F.min("similarity").alias("last")).where((F.col("n") >= enough) & (F.col("hits") >= curves.agree))
    # Where the accessions next in order are as near as one-byte numbers can tell, the best k may be among those that windows left out.
    over = pairs.where(F.col("place") == max(curves.keep, enough + 1)).groupBy("query_id").agg(F.max("similarity").alias("over"))
    sure = sure.join(over, "query_id", "left").where(F.col("over").isNull() | (F.col("last") - F.col("over") >= _code_error(F.col("last"))))
    unsure = cut(coded_queries.select(F.col("id").alias("query_id")).join(sure, "query_id", "left_anti"), "unsure")
    pairs = pairs.select("query_id", "ref_id")
    if not entries.where("n > 1").isEmpty():
        pairs = pairs.unionByName(pairs.join(others, "ref_id").select("query_id", F.col("other").alias("ref_id")))
    if enough and not unsure.isEmpty():
        more = exact(unsure.join(q, "query_id").drop("q_length"), one.select(F.col("id").alias("ref_id")).join(r, "ref_id").drop("r_length"), max(k, curves.final))
        pairs = pairs.join(unsure, "query_id", "left_anti").unionByName(cut(more, "exact-pairs"))
    ranked = (
        pairs.join(r, "ref_id")
        .join(q, "query_id")
        .select("query_id", "ref_accession", (1 - dot(doubles("q"), doubles("r")) / (F.col("q_length") * F.col("r_length"))).alias("distance"))
        .groupBy("query_id", "ref_accession")
        .agg(F.min("distance").alias("distance"))
    )
    order = Window.partitionBy("query_id").orderBy("distance", "ref_accession")
    out = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # What one of the equal queries found goes to all; vectors of very many queries are spread over tasks.
    hot = F.broadcast(coded_queries.where(F.col("n") > TWINS).select("name", F.ceil(F.col("n") / TWINS).cast("int").alias("parts")))
    found = out.join(coded_queries.select(F.col("id").alias("query_id"), "name", F.ceil(F.col("n") / TWINS).cast("int").alias("parts")), "query_id")
    found = found.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = every.select("id", "name").distinct().join(hot, "name", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id"), "parts").cast("int"), F.lit(0)))
    return asked.select("id", "name", "part").join(found, ["name", "part"]).select(F.col("id").alias("query_pos"), "ref_accession", "distance", "rank")
