"""Filling fixed-capacity containers with texts: conflict-constrained best fit."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kinvote.functions import clean
from kinvote.llm.tokens import VOCABULARY, measured, spread
from kinvote.sources.scratch import cut

CAPACITY = 4096
#: Tokens of items that one task packs; a parameter of the parallelism, not of the result's validity.
SHARD_TOKENS = 4_000_000
#: Items of a shard at most on average, for texts of a few tokens.
SHARD_ITEMS = 200_000
#: Containers with more unused space than this share are packed again with others.
LOOSE = 0.02

PLACED = T.StructType(
    [T.StructField("bin_id", T.StringType()), T.StructField("item", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("n_tokens", T.LongType()), T.StructField("used", T.LongType()), T.StructField("source", T.StringType()), T.StructField("content", T.LongType())]
)


class Packer:
    """Best fit over bins ordered by residual space, with conflicts as bitmaps.

    ``by_space[r]`` holds the bins with r tokens left and ``spaces`` is a
    bitmap of the r that occur, so the successor of an item's size is a few bit
    operations away. A bin carries one bitmap of the limited sources it holds, so that
    their sums are looked up only there, and one of the duplicate clusters that
    are full in it; an item walks up the residuals until it meets the tightest
    bin that conflicts with neither.
    """

    def __init__(self, capacity: int, source_limit: dict, cluster_limit: dict) -> None:
        self.capacity, self.source_limit, self.cluster_limit = capacity, source_limit, cluster_limit
        self.by_space: dict[int, list[int]] = defaultdict(list)
        self.spaces = 0
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.space: list[int] = []
        self.held: list[dict] = []
        self.source_bit: dict = {}
        self.cluster_bit: dict = {}

    def add(self, size: int, source, cluster) -> int:
        """The bin that takes the item; a new one if no open bin is compatible."""
        sbit = 1 << self.source_bit.setdefault(source, len(self.source_bit))
        cbit = 0 if cluster is None else 1 << self.cluster_bit.setdefault(cluster, len(self.cluster_bit))
        limit = self.source_limit.get(source, self.capacity)
        above = self.spaces >> size << size
        while above:
            r = (above & -above).bit_length() - 1
            for k, b in enumerate(self.by_space[r]):
                if not (self.sources[b] & sbit and self.held[b].get(source, 0) + size > limit) and not self.clusters[b] & cbit:
                    self.by_space[r].pop(k)
                    if not self.by_space[r]:
                        self.spaces &= ~(1 << r)
                    self._put(b, size, source, sbit, cluster, cbit, limit)
                    return b
            above &= above - 1
        b = len(self.space)
        self.space.append(self.capacity)
        self.sources.append(0)
        self.clusters.append(0)
        self.held.append({})
        self._put(b, size, source, sbit, cluster, cbit, limit)
        return b

    def _put(self, b: int, size: int, source, sbit: int, cluster, cbit: int, limit: int) -> None:
        held, r = self.held[b], self.space[b] - size
        held[source] = held.get(source, 0) + size
        if limit < self.capacity:
            self.sources[b] |= sbit
        if cbit:
            n = held[("cluster", cluster)] = held.get(("cluster", cluster), 0) + 1
            if n >= self.cluster_limit.get(cluster, 1):
                self.clusters[b] |= cbit
        self.space[b] = r
        if r:
            self.by_space[r].append(b)
            self.spaces |= 1 << r


def pack(sizes: list[int], sources: list, clusters: list, capacity: int, source_share: float) -> list[int]:
    """Bin numbers of items by best fit in decreasing order of size (ties keep the given order).

    Two items of one cluster share no bin, and a source fills at most
    ``source_share`` of one, as far as that can be without more bins: a cluster
    with more items than the least number of bins may come up as often as the
    pigeonhole principle asks, and a source that dominates gets its own share
    plus a quarter. An item larger than its
    source's share may still join a bin without that source. A cluster of one
    item can't conflict and needs no bit.
    """
    total = sum(sizes)
    least = max(1, -(-total // capacity))
    counts: dict = defaultdict(int)
    weight: dict = defaultdict(int)
    for size, source, cluster in zip(sizes, sources, clusters):
        weight[source] += size
        if cluster is not None:
            counts[cluster] += 1
    limits = {s: int(capacity * min(1.0, max(source_share, w / max(total, 1) + 0.25))) for s, w in weight.items()}
    bins = Packer(capacity, limits, {c: -(-n // least) for c, n in counts.items() if n > least})
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        out[i] = bins.add(sizes[i], sources[i], clusters[i] if counts.get(clusters[i], 0) > 1 else None)
    return out


def _packed(items: DataFrame, shard: Column, prefix: str, capacity: int, source_share: float) -> DataFrame:
    """Pack the items of each shard in one task."""
    arrow = to_arrow_schema(PLACED)

    def run(items: pa.Table) -> pa.Table:
        items = items.sort_by([("n_tokens", "descending"), ("item", "ascending"), ("piece", "ascending")])
        sizes, shard_ids = items["n_tokens"].to_pylist(), items["_shard"].to_pylist()
        at = pack(sizes, items["source"].to_pylist(), items["content"].to_pylist(), capacity, source_share)
        used: dict[int, int] = defaultdict(int)
        for b, size in zip(at, sizes):
            used[b] += size
        named = {"bin_id": pa.array([f"{prefix}{s}-{b}" for s, b in zip(shard_ids, at)], "string"), "used": pa.array([used[b] for b in at], "i8")}
        return pa.table([named[f.name] if f.name in named else items[f.name].cast(f.type) for f in arrow], schema=arrow)

    return items.withColumn("_shard", shard).groupBy("_shard").applyInArrow(run, PLACED)


def fill_containers(items: DataFrame, capacity: int = CAPACITY, source_share: float = 0.75, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Place ``items`` (item L, n_tokens L, source S, content L) into containers of ``capacity``.

    Returns one row per piece: ``bin_id``, ``item``, ``piece`` (from 0),
    ``start``, ``n_tokens`` and ``used`` (tokens in the container). An item
    beyond the capacity, and no other, is cut: its full pieces take a container
    each and the rest is packed like an item. Items without tokens need no
    container and come out with a null ``bin_id``; null sizes count as 0.
    Null sources are one source; a null ``content`` belongs to no duplicate
    cluster. Repeated items are packed as often as they are given; ties are
    broken by item. An empty table gives an empty result.

    Items are spread by hash over shards of about ``shard_tokens`` tokens, each
    packed by one task; the items of all containers that are left with more than
    2 % unused are spread over shards of the same bounds and packed again.
    """
    rows = items.select("item", F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).cast("long").alias("n"), "source", "content")
    full = F.floor(F.col("n") / capacity).cast("int")
    # Equal oversized items are counted first and numbered then, so that every full piece has a name of its own, the same in every run.
    whole = (
        rows.where(F.col("n") > capacity)
        .groupBy("item", "n", "source", "content").agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .withColumn("name", F.concat_ws("-", F.lit("c"), F.hex(F.xxhash64("item", "n", "source", "content")), "item", "copy"))
        .select("name", "item", "n", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece"))
        .select(F.concat_ws("-", "name", "piece").alias("bin_id"), "item", "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.lit(capacity).cast("long").alias("n_tokens"), F.lit(capacity).cast("long").alias("used"))
    )
    rest = rows.select("item", F.when(F.col("n") > capacity, full).otherwise(F.lit(0)).alias("piece"), F.when(F.col("n") > capacity, F.col("n") % capacity).otherwise(F.col("n")).alias("n_tokens"), "n", "source", "content")
    empty = rest.where(F.col("n") == 0).select(F.lit(None).cast("string").alias("bin_id"), "item", "piece", F.lit(0).cast("long").alias("start"), "n_tokens", F.lit(0).cast("long").alias("used"))
    rest = rest.where(F.col("n_tokens") > 0).drop("n")
    total, count = rest.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count(F.lit(1))).first()
    shards = max(1, -(-total // shard_tokens), -(-count // SHARD_ITEMS))
    first = cut(_packed(rest, F.pmod(F.xxhash64("item", "piece"), F.lit(shards)), "a", capacity, source_share), "packed")
    loose = F.col("used") < int(capacity * (1 - LOOSE))
    again = first.where(loose)
    if shards > 1:
        total, count = again.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count(F.lit(1))).first()
        shards = max(1, -(-total // shard_tokens), -(-count // SHARD_ITEMS))
        again = _packed(again.drop("bin_id", "used"), F.pmod(F.xxhash64("item", "piece", F.lit("again")), F.lit(shards)), "b", capacity, source_share)
    placed = first.where(~loose).unionByName(again).select("bin_id", "item", "piece", (F.col("piece").cast("long") * capacity).alias("start"), "n_tokens", "used")
    return whole.unionByName(placed).unionByName(empty)


def sized_documents(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(item, source, n_tokens, content) of ``documents``: what ``fill_containers`` takes."""
    return measured(spread(documents.select(F.col("doc_id").alias("item"), clean.source_key(F.col("source")).alias("source"), "text"), "item"), vocabulary=vocabulary)


def container_report(items: DataFrame, placed: DataFrame, capacity: int = CAPACITY, source_share: float = 0.75) -> DataFrame:
    """One row on the containers ``placed`` of ``items``, whose ids must be unique.

    ``containers``, the ``least`` number that any packing needs (each cut item
    gives its full pieces), ``overfull`` and ``misstated`` containers (beyond the
    capacity, or whose ``used`` is not the sum of their pieces), ``lost`` items (whose
    pieces are not their tokens), ``cut_needlessly``, and the containers that
    hold copies of one text (``with_copies``) or more than ``source_share`` of one source (``one_sided``).
    """
    own = placed.where("bin_id is not null").join(items.select("item", "source", "content"), "item")
    bins = own.groupBy("bin_id").agg(F.sum("n_tokens").alias("held"), F.max("used").alias("used"))
    copies = own.where("content is not null").groupBy("bin_id", "content").agg(F.countDistinct("item").alias("n")).where("n > 1").select("bin_id").distinct()
    sides = own.groupBy("bin_id", "source").agg(F.sum("n_tokens").alias("n"), F.countDistinct("item").alias("k")).where((F.col("n") > capacity * source_share) & (F.col("k") > 1)).select("bin_id").distinct()
    pieces = placed.groupBy("item").agg(F.sum("n_tokens").alias("got"), F.count(F.lit(1)).alias("pieces"))
    whole = items.join(pieces, "item", "left").select(F.coalesce("n_tokens", F.lit(0)).alias("n"), F.coalesce("got", F.lit(-1)).alias("got"), F.coalesce("pieces", F.lit(0)).alias("pieces"))
    on_items = whole.agg(F.count_if(F.col("n") != F.col("got")).alias("lost"), F.count_if(F.col("pieces") > F.greatest(F.ceil(F.col("n") / capacity), F.lit(1))).alias("cut_needlessly"), F.sum(F.floor(F.col("n") / capacity)).alias("full"), F.sum(F.col("n") % capacity).alias("rest"))
    on_bins = bins.agg(F.count(F.lit(1)).alias("containers"), F.count_if(F.col("held") > capacity).alias("overfull"), F.count_if(F.col("held") != F.col("used")).alias("misstated"))
    count = lambda rows, name: rows.agg(F.count(F.lit(1)).alias(name))
    one = on_bins.join(F.broadcast(on_items)).join(F.broadcast(count(copies, "with_copies"))).join(F.broadcast(count(sides, "one_sided")))  # one row each
    return one.select("containers", (F.coalesce("full", F.lit(0)) + F.ceil(F.coalesce("rest", F.lit(0)) / capacity)).alias("least"), "overfull", "misstated", "lost", "cut_needlessly", "with_copies", "one_sided")


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Containers of the texts of ``documents`` (doc_id, source, text), see ``fill_containers``.

    Exact copies of a text form a duplicate cluster. Sources count by their
    normal form.
    """
    sized = cut(sized_documents(documents, vocabulary), "tokens")
    return fill_containers(sized, capacity).withColumnRenamed("item", "doc_id")


def oversized(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """The documents whose text had to be cut."""
    return pack_documents(documents, capacity, vocabulary).where(F.col("piece") > 0).select("doc_id").distinct()
