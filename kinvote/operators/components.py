"""Connected components: local contraction, then alternating star contraction, wholly distributed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kinvote.operators.skew import counted_join
from kinvote.sources.scratch import cut, drop

#: Links that one task contracts on average at most (about 100 bytes a link there).
TASK_LINKS = 1_000_000

LINKS = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node of each one's component) of a few links, by hooking roots to lesser ones."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return nodes, nodes[root]
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up


def _contracted(links: DataFrame, tasks: int) -> DataFrame:
    """Links with the same components: within each of ``tasks`` even parts every node hangs on the least node it reaches there."""
    arrow = to_arrow_schema(LINKS)

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
        if own:
            nodes, roots = forest(*(np.concatenate(x) for x in zip(*own)))
            hangs = nodes != roots
            yield from pa.table({"u": nodes[hangs], "v": roots[hangs]}, schema=arrow).to_batches()

    # Parts go by the hash of the whole link, so that a node with very many links is in all of them.
    parts = links.repartition(tasks, F.xxhash64("u", "v")) if tasks > 1 else links.coalesce(1)
    return parts.mapInArrow(contract, LINKS)


def _stars(pairs: DataFrame) -> DataFrame:
    """For rows (u, v) link every v and u itself to the least node among u and its v's."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n")).select("u", F.least("u", "m").alias("m"), "_n")
    return counted_join(pairs, least, ["u"], "_n", ["v"])


def _settled(links: DataFrame) -> bool:
    """Whether ``links`` is a star forest: one link per node, and no node that is linked has a link below it."""
    roles = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    each = roles.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not each.where("up > 1 or (up > 0 and down > 0)").limit(1).count()


def components(edges: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """(node, root) for the nodes of undirected ``edges`` (u L, v L); root is the least node of the component.

    Even parts of about ``task_links`` links are first contracted to star
    forests, each by itself; one part is then done. Several are joined by
    large-star and small-star steps, which alternate until every node hangs directly
    on its root, in a logarithmic number of rounds in practice even
    for long chains. A step only keeps minima per node and rewires links, so a
    node with very many links is combined before the shuffle and its join side
    is spread over tasks; no component is ever gathered. Nulls
    and self-links say nothing and are skipped, so a node with only those does
    not come out; repeated links count once. Each round is a written table.
    """
    given = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v"), "edges")
    tasks = max(1, -(-given.count() // task_links))
    links = cut(_contracted(given, tasks), "links")
    drop(given)
    while tasks > 1 and not _settled(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        stars = _stars(large)
        small = stars.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(stars.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        after = cut(small, "links")
        drop(links)
        links = after
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return cut(links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), "components")
