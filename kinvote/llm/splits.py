"""Train, validation and test splits that keep related records together."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinvote.functions import clean
from kinvote.llm.ranges import numbered, positioned
from kinvote.operators.components import components
from kinvote.operators.skew import counted_join
from kinvote.sources.scratch import cut

SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: Most distinct (size, label profile) bundles that the driver allocates one by one.
MAX_BUNDLES = 200_000
SEED = 23

_BOUNDS = T.StructType([T.StructField("_bundle", T.StringType()), T.StructField("_split", T.StringType()), T.StructField("_from", T.LongType()), T.StructField("_to", T.LongType())])


def tied(members: DataFrame, keys: DataFrame) -> DataFrame:
    """(id, group_id) for ``members`` (id L) tied by ``keys`` (id L, kind S, key S), as a written table.

    Two ids with the same (kind, key) are tied, directly or through others;
    ``group_id`` is the least id of the group. A key with any number of rows is
    only ever combined to its least id; ids with one such least id hang on it
    directly, and only ids that join several of them go into the components.
    Null ids are skipped, null keys tie nothing, repeated rows count once.
    """
    members, keys = members.select("id").dropna().distinct(), keys.dropna().distinct()
    least = keys.groupBy("kind", "key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    ties = cut(counted_join(keys, least, ["kind", "key"], "n", ["id"]).select("id", "rep").distinct(), "ties")
    own = cut(ties.groupBy("id").agg(F.min("rep").alias("rep"), F.max("rep").alias("far"), F.count(F.lit(1)).alias("n")), "own-ties")
    # The least id of a key hangs on itself there, so it also joins any lesser one it is tied to.
    middle = ties.join(own.where("n > 2").select("id", F.col("rep").alias("near"), "far"), "id").where("rep > near and rep < far").select(F.col("near").alias("u"), F.col("rep").alias("v"))
    links = own.where("n > 1").select(F.col("rep").alias("u"), F.col("far").alias("v")).unionByName(middle)
    roots = components(links).select(F.col("node").alias("rep"), "root")
    placed = own.join(roots, "rep", "left").select("id", F.coalesce("root", "rep").alias("group_id"))
    return cut(members.join(placed, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id")), "groups")


def groups(members: DataFrame, keys: DataFrame) -> DataFrame:
    """``tied`` with ``group_size``."""
    grouped = tied(members, keys)
    sizes = grouped.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size")).withColumn("_n", F.col("group_size"))
    return counted_join(grouped, sizes, ["group_id"], "_n", ["id"])


class _Flow:
    """Min-cost flow of single units from bundles to splits under split quotas.

    Each unit first takes its cheapest split. While a split holds more than its
    quota, one unit is moved along the cheapest chain of moves that ends in a
    split with room: a shortest augmenting path in the residual graph, whose
    nodes are the splits and whose links are the cheapest moves between them.
    """

    def __init__(self, costs: list[tuple[float, ...]], quotas: list[int]) -> None:
        self.costs, self.k = costs, len(quotas)
        self.at = [min(range(self.k), key=c.__getitem__) for c in costs]
        self.heaps: list[list[list]] = [[[] for _ in range(self.k)] for _ in range(self.k)]
        self.room = list(quotas)
        for u in range(len(costs)):
            self.room[self.at[u]] -= 1
            self._offer(u)
        while min(self.room) < 0:
            self._augment()

    def _offer(self, u: int) -> None:
        s, c = self.at[u], self.costs[u]
        for t in range(self.k):
            if t != s:
                heapq.heappush(self.heaps[s][t], (c[t] - c[s], u))

    def _best(self, s: int, t: int) -> tuple[float, int] | None:
        heap = self.heaps[s][t]
        while heap and self.at[heap[0][1]] != s:
            heapq.heappop(heap)
        return heap[0] if heap else None

    def _augment(self) -> None:
        k = self.k
        start = next(s for s in range(k) if self.room[s] < 0)
        dist, by = [math.inf] * k, [None] * k
        dist[start] = 0.0
        for _ in range(k):
            for s in range(k):
                for t in range(k):
                    if s != t and dist[s] < math.inf and (move := self._best(s, t)) and dist[s] + move[0] < dist[t] - 1e-12:
                        dist[t], by[t] = dist[s] + move[0], (s, move[1])
        end = min((t for t in range(k) if self.room[t] > 0), key=dist.__getitem__)
        self.room[start] += 1
        self.room[end] -= 1
        while end != start:
            s, u = by[end]
            self.at[u] = end
            self._offer(u)
            end = s


def _round(wanted: list[float], total: int) -> list[int]:
    """Whole numbers near ``wanted`` that add up to ``total``: floors, then the largest remainders."""
    floors = [max(0, math.floor(w + 1e-9)) for w in wanted]
    while sum(floors) > total:
        floors[max(range(len(floors)), key=lambda i: floors[i] - wanted[i])] -= 1
    for i in sorted(range(len(floors)), key=lambda i: floors[i] - wanted[i])[: total - sum(floors)]:
        floors[i] += 1
    while sum(floors) < total:
        floors[max(range(len(floors)), key=lambda i: wanted[i] - floors[i])] += 1
    return floors


def allocate(bundles: list[tuple[float, float, int]], shares: list[float]) -> list[list[int]]:
    """How many components of every bundle go to every split.

    ``bundles`` are (rows, positive rows, number of components). Sizes are
    taken from the largest to the smallest. The quotas of a size are what its
    splits still lack of their share of all rows so far, rounded to whole
    components, so deviations never add up. Of each bundle the whole part of
    its even share is fixed; the few remaining units are a min-cost flow to the
    open quotas, a unit's cost being the deviation that it causes in the rows
    and in the positive rows of its split, in fractions of a component.
    """
    k = len(shares)
    out = [[0] * k for _ in bundles]
    by_size: dict[float, list[int]] = {}
    for i, b in enumerate(bundles):
        by_size.setdefault(b[0], []).append(i)
    rows, given, positives, got = 0.0, [0.0] * k, 0.0, [0.0] * k
    for size in sorted(by_size, reverse=True):
        own = by_size[size]
        count = sum(bundles[i][2] for i in own)
        rows += size * count
        quota = _round([max(0.0, (p * rows - g) / max(size, 1)) for p, g in zip(shares, given)], count)
        left, units, costs = list(quota), [], []
        for i in own:
            n = bundles[i][2]
            whole = [min(math.floor(p * n), q) for p, q in zip(shares, left)]
            for s in range(k):
                out[i][s] += whole[s]
                left[s] -= whole[s]
                got[s] += whole[s] * bundles[i][1]
            positives += n * bundles[i][1]
            for j in range(n - sum(whole)):
                even = [p * n - w for p, w in zip(shares, whole)]
                lack = [p * positives - g for p, g in zip(shares, got)]
                tilt = bundles[i][1] / max(size, 1)
                costs.append(tuple(-even[s] - tilt * lack[s] / max(size, 1) * 0.1 for s in range(k)))
                units.append(i)
        if units:
            for i, s in zip(units, _Flow(costs, left).at):
                out[i][s] += 1
                got[s] += bundles[i][1]
        for s in range(k):
            given[s] += size * quota[s]
    return out


#: Ways to bundle, from exact to coarse: leading bits of the size, steps of the positive share.
#: The last one has at most 64 bundles.
_COARSER = (None, (3, 16), (1, 4), (0, 0))


def _profile(size: Column, positives: Column, way: tuple[int, int] | None) -> Column:
    """The bundle of a component."""
    if way is None:
        return F.concat_ws("/", size, positives)
    bits, steps = way
    step = F.greatest(F.lit(1), F.pow(F.lit(2.0), F.floor(F.log2(size)) - bits)).cast("long")
    return F.concat_ws("/", F.floor(size / step) * step, F.round(positives / size * steps).cast("int"))


def assign(records: DataFrame, grouped: DataFrame, label: str = "label", shares: dict[str, float] = SPLITS) -> DataFrame:
    """``grouped`` (id, group_id; a written table) with ``group_size`` and ``split`` of the group.

    ``records`` (id L, ``label``) gives the label profile: how many ids of a
    group have label 1 (the largest label of an id counts; null labels count as
    rows only). Groups of identical size and profile form a bundle; the quotas
    are solved per bundle (see ``allocate``), and within a bundle the groups
    are put in the order of a hash and counted off by exact positions, so a
    bundle of any size is spread over tasks. If there are more than
    ``MAX_BUNDLES`` different bundles, similar sizes and profiles are bundled,
    so that every group is still allocated.
    """
    spark = records.sparkSession
    labels = records.groupBy("id").agg(F.max(label).alias("label"))
    profiles = cut(
        grouped.join(labels, "id", "left").groupBy("group_id").agg(F.count(F.lit(1)).alias("size"), F.sum((F.coalesce("label", F.lit(0)) == 1).cast("long")).alias("positives")),
        "profiles",
    )
    for way in _COARSER:
        bundled = profiles.withColumn("_bundle", _profile(F.col("size"), F.col("positives"), way))
        bundles = bundled.groupBy("_bundle").agg(F.sum("size").alias("rows"), F.sum("positives").alias("positives"), F.count(F.lit(1)).alias("n")).limit(MAX_BUNDLES + 1).collect()
        if len(bundles) <= MAX_BUNDLES:
            break
    else:
        raise ValueError("MAX_BUNDLES must be at least 64")
    bundles.sort(key=lambda b: b["_bundle"])
    counts = allocate([(b["rows"] / b["n"], b["positives"] / b["n"], b["n"]) for b in bundles], list(shares.values()))
    bounds = []
    for b, row in zip(bundles, counts):
        start = 0
        for split, n in zip(shares, row):
            if n:
                bounds.append((b["_bundle"], split, start, start + n))
            start += n
    placed = positioned(numbered(bundled.select("_bundle", "group_id", F.col("size").alias("_size"), F.xxhash64(F.lit(SEED), "group_id").alias("_hash")), "_bundle", ["_hash", "group_id"]), "_bundle")
    # At most MAX_BUNDLES * number of splits rows.
    chosen = placed.join(F.broadcast(spark.createDataFrame(bounds, _BOUNDS)), "_bundle").where("_pos > _from and _pos <= _to").select("group_id", F.col("_size").alias("group_size"), F.col("_split").alias("split"), "_size")
    return counted_join(grouped, chosen, ["group_id"], "_size", ["id"]).select("id", "group_id", "group_size", "split")


def split_training_rows(rows: DataFrame, shares: dict[str, float] = SPLITS) -> DataFrame:
    """(example_id, group_id, group_size, split) for every example of ``rows``.

    Rows are tied by the core of ``protein_accession`` (one letter and eight
    digits) or by ``seq_checksum`` (without white space and case); values that
    say nothing tie nothing, and deliveries of one example_id are one example.
    An example without ties is a group of its own. Rows with a null example_id
    are no examples. An empty table gives an empty result.
    """
    rows = rows.select(F.col("example_id").alias("id"), clean.accession_core(F.col("protein_accession")).alias("core"), clean.checksum_key(F.col("seq_checksum")).alias("checksum"), "label").where("id is not null")
    keys = rows.select("id", F.explode(F.array(F.struct(F.lit("a").alias("kind"), F.col("core").alias("key")), F.struct(F.lit("c").alias("kind"), F.col("checksum").alias("key")))).alias("k")).select("id", "k.kind", "k.key")
    return assign(rows, tied(rows, keys), "label", shares).select(F.col("id").alias("example_id"), "group_id", "group_size", "split")
