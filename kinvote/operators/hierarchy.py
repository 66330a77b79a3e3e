"""Parent-child links to full hierarchies: depths, paths, descendants and cycles.

Links form a graph in which a node may have several parents. Connected
components are found first; the components are then co-located, each wholly in
one task, and walked there by an iterative depth-first traversal with node
colouring. A component with more links than ``max_links`` is never gathered:
its results come from distributed joins with the same definitions.

Definitions, the same on both ways. A *top* is a node without parents; where a
cycle has no way out, its least node stands in as top. ``depth`` is the least
number of steps to a top and ``path`` the path of that length that is least by
node at every step. A node is on a *cycle* if it reaches itself by one or more
links; the nodes that reach each other form its cycle group (strongly connected
component). A *back link* is a link inside a cycle group that does not lower
the depth: every cycle has one, and without them no cycle is left, whatever the
order of the walk. Paths use all links but these, which leaves finitely many
and at least one for each node. Descendants of a node are all other nodes that
reach it, ancestors all that it reaches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kinvote.functions import clean
from kinvote.operators.components import components
from kinvote.sources.scratch import cut, drop

#: Links of a component up to which one task walks it (about 100 bytes a link there).
MAX_LINKS = 3_000_000
#: Nodes of a component from which on its output is shared between tasks, one per so many nodes ...
BLOCK = 4096
#: ... but so many at most, whatever its size: each has a copy of the links.
PARTS = 16
#: Path steps or related nodes that are handed on at a time.
CHUNK = 1_000_000
#: Links that one task of small components has on average at most.
TASK_LINKS = 500_000

NODES = T.StructType(
    [T.StructField("node", T.LongType()), T.StructField("component", T.LongType()), T.StructField("depth", T.IntegerType()), T.StructField("top", T.LongType()), T.StructField("path", T.ArrayType(T.LongType())), T.StructField("on_cycle", T.BooleanType()), T.StructField("cycle", T.LongType())]
)
BACK = T.StructType([T.StructField("child", T.LongType()), T.StructField("parent", T.LongType())])
BELOW = T.StructType([T.StructField("node", T.LongType()), T.StructField("descendants", T.ArrayType(T.LongType()))])
PATHS = T.StructType([T.StructField("node", T.LongType()), T.StructField("top", T.LongType()), T.StructField("path", T.ArrayType(T.LongType()))])


class Walk:
    """One or more whole components in memory, walked depth-first from child to parent.

    White nodes are unseen, grey ones are on the current path, black ones are
    done. A link to a grey node closes a cycle; the low links of the same walk
    give the cycle groups. ``full`` also works out depths, paths and back links.
    """

    def __init__(self, child: np.ndarray, parent: np.ndarray, full: bool = True) -> None:
        self.names = np.unique(np.concatenate([child, parent]))
        c, p = np.searchsorted(self.names, child), np.searchsorted(self.names, parent)
        order = np.lexsort((p, c))
        c, p = c[order], p[order]
        self.n = len(self.names)
        self.start = np.searchsorted(c, np.arange(self.n + 1))
        self.to, self.child = p, c
        if full:
            self._walk()
            self._levels(c, p)

    def _walk(self) -> None:
        n, start, to = self.n, self.start.tolist(), self.to.tolist()
        seen, low, group = [0] * n, [0] * n, [-1] * n
        colour = bytearray(n)  # 0 white, 1 grey, 2 black
        at, pending, clock = start[:n], [], 0
        for first in range(n):
            if colour[first]:
                continue
            path = [first]
            while path:
                v = path[-1]
                if not colour[v]:
                    colour[v] = 1
                    clock += 1
                    seen[v] = low[v] = clock
                    pending.append(v)
                if at[v] < start[v + 1]:
                    w = to[at[v]]
                    at[v] += 1
                    if not colour[w]:
                        path.append(w)
                    elif colour[w] == 1 or group[w] < 0:  # grey, or black in a group that is not closed yet
                        low[v] = min(low[v], seen[w])
                    continue
                path.pop()
                colour[v] = 2
                if path:
                    low[path[-1]] = min(low[path[-1]], low[v])
                if low[v] == seen[v]:
                    members = []
                    while True:
                        w = pending.pop()
                        members.append(w)
                        if w == v:
                            break
                    least = min(members)
                    for w in members:
                        group[w] = least
        self.group = np.array(group)

    def _levels(self, c: np.ndarray, p: np.ndarray) -> None:
        """Depths by level from the tops down; the least parent one level up leads the path."""
        n, group = self.n, self.group
        size = np.bincount(group, minlength=n)
        own = c == p
        self.on_cycle = size[group] > 1
        self.on_cycle[c[own]] = True
        leaves = np.zeros(n, bool)  # groups with a link out of the group
        leaves[group[c[group[c] != group[p]]]] = True
        self.depth = np.full(n, -1)
        lead = np.full(n, -1)
        self.depth[(group == np.arange(n)) & ~leaves] = 0
        by_parent = np.lexsort((c, p))
        first = np.searchsorted(p[by_parent], np.arange(n + 1))
        children, level, frontier = c[by_parent], 0, np.flatnonzero(self.depth == 0)
        while len(frontier):
            counts = first[frontier + 1] - first[frontier]
            where = np.repeat(first[frontier] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
            below, above = children[where], np.repeat(frontier, counts)
            fresh = self.depth[below] < 0
            below, above = below[fresh], above[fresh]
            order = np.lexsort((above, below))
            below, index = np.unique(below[order], return_index=True)
            lead[below] = above[order][index]
            level += 1
            self.depth[below] = level
            frontier = below
        self.lead = lead
        kept = (group[c] != group[p]) | (self.depth[p] < self.depth[c])
        self.up_start = np.searchsorted(c[kept], np.arange(n + 1))
        self.up = p[kept]
        self.back = np.stack([c[~kept], p[~kept]])

    def path(self, v: int) -> list[int]:
        out = [v]
        while self.lead[v] >= 0:
            v = int(self.lead[v])
            out.append(v)
        return out

    def paths(self, v: int) -> Iterator[list[int]]:
        """All paths of ``v`` to tops, least first."""
        start, up = self.up_start, self.up
        path, at = [v], [int(start[v])]
        while path:
            u = path[-1]
            if start[u] == start[u + 1]:
                yield path.copy()
            elif at[-1] < start[u + 1]:
                w = int(up[at[-1]])
                at[-1] += 1
                path.append(w)
                at.append(int(start[w]))
                continue
            path.pop()
            at.pop()

    def related(self, nodes: np.ndarray, down: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(nodes, counts, others): the descendants or ancestors of ``nodes``, ascending, some nodes at a time.

        Every node is walked by itself, so the work is that of the links among
        what comes out, and nothing is kept but the chunk at hand.
        """
        if down:
            order = np.argsort(self.to, kind="stable")
            to, start = self.child[order].tolist(), np.searchsorted(self.to[order], np.arange(self.n + 1)).tolist()
        else:
            to, start = self.to.tolist(), self.start.tolist()
        mark, own, counts, flat = [-1] * self.n, [], [], []
        for v in nodes.tolist():
            mark[v], found = v, []
            todo = to[start[v] : start[v + 1]]
            while todo:
                w = todo.pop()
                if mark[w] != v:
                    mark[w] = v
                    found.append(w)
                    todo.extend(to[start[w] : start[w + 1]])
            if found:
                found.sort()
                own.append(v)
                counts.append(len(found))
                flat.extend(found)
                if len(flat) >= CHUNK:
                    yield np.array(own), np.array(counts), np.array(flat)
                    own, counts, flat = [], [], []
        if own:
            yield np.array(own), np.array(counts), np.array(flat)


def term_links(term_parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, nodes) by number: distinct ``child``, ``parent`` and every distinct ``node``.

    Only the number of an identifier counts; a child without a number is
    skipped, a parent without one makes no link.
    """
    rows = term_parents.select(clean.term_number(F.col("go_id")).alias("child"), clean.term_number(F.col("parent_id")).alias("parent"))
    rows = cut(rows.distinct(), "term-links")
    links = rows.dropna()
    nodes = rows.select(F.col("child").alias("node")).unionByName(rows.select(F.col("parent").alias("node"))).dropna().distinct()
    return links, nodes


class Hierarchy:
    """Links (child L, parent L) and nodes (node L), split by component.

    Nulls in links are skipped and repeated links count once; nodes that no
    link names are components of their own. Empty tables give empty results.
    """

    def __init__(self, links: DataFrame, nodes: DataFrame, max_links: int = MAX_LINKS) -> None:
        links = links.dropna().select("child", "parent").distinct()
        own = components(links.select(F.col("child").alias("u"), F.col("parent").alias("v")))
        # Nodes of self-links only, and of no link at all, are components of their own.
        self.nodes = cut(nodes.select("node").unionByName(links.select(F.explode(F.array("child", "parent")).alias("node"))).dropna().distinct().join(own, "node", "left").select("node", F.coalesce("root", "node").alias("component")), "nodes")
        placed = links.join(self.nodes.withColumnRenamed("node", "child"), "child")
        self.links = cut(placed.select("component", "child", "parent"), "component-links")
        sizes = cut(self.links.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "sizes")
        total, most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        self.tasks = max(int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_LINKS))
        self.small, self.big, self.has_big = self.links, None, most > max_links
        if self.has_big:
            big = sizes.where(F.col("n") > max_links).select("component")
            self.small = self.links.join(big, "component", "left_anti")
            self.big = self.links.join(big, "component", "left_semi")

    def _unit(self) -> Column:
        """The task of a component."""
        return F.pmod(F.xxhash64("component"), F.lit(self.tasks))

    def _walked(self, schema: T.StructType, emit: Callable[[Walk], Iterator[pa.Table]]) -> DataFrame:
        """Apply ``emit`` to the co-located components: all of a task's components make one walk."""
        arrow = to_arrow_schema(schema)

        def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            links = pa.Table.from_batches(list(batches))
            for table in emit(Walk(links["child"].to_numpy(), links["parent"].to_numpy())):
                yield from table.cast(arrow).combine_chunks().to_batches()

        return self.small.select("child", "parent", self._unit().alias("_unit")).groupBy("_unit").applyInArrow(run, schema)

    def _shared(self, wanted: DataFrame, schema: T.StructType, emit: Callable[[Walk, np.ndarray], Iterator[pa.Table]], full: bool) -> DataFrame:
        """Apply ``emit`` to the components and their ``wanted`` nodes (node, component).

        The wanted nodes of a component of more than ``BLOCK`` are shared
        between ``PARTS`` tasks at most, each with its own copy of the links; components
        without a wanted node are left out.
        """
        arrow = to_arrow_schema(schema)

        def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(list(batches))
            asked = rows["parent"].is_null()
            links, own = rows.filter(pc.invert(asked)), np.sort(rows.filter(asked)["child"].to_numpy())
            if links.num_rows and len(own):
                walk = Walk(links["child"].to_numpy(), links["parent"].to_numpy(), full)
                at = np.searchsorted(walk.names, own).clip(0, walk.n - 1)
                for table in emit(walk, at[walk.names[at] == own]):
                    yield from table.cast(arrow).combine_chunks().to_batches()

        parts = wanted.groupBy("component").agg(F.least(F.ceil(F.count(F.lit(1)) / BLOCK), F.lit(PARTS)).cast("int").alias("_parts"))
        part = F.when(F.col("_parts") > 1, F.pmod(F.xxhash64("node"), "_parts")).otherwise(F.lit(0)).cast("int")
        # A component in several parts is in a unit of its own, so that its parts are tasks.
        unit = F.when(F.col("_parts") > 1, F.col("component")).otherwise(-1 - self._unit())
        nodes = wanted.join(parts, "component").select(unit.alias("_unit"), part.alias("_part"), F.col("node").alias("child"), F.lit(None).cast("long").alias("parent"))
        links = self.small.join(parts, "component").select(unit.alias("_unit"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), "child", "parent")
        return links.unionByName(nodes).groupBy("_unit", "_part").applyInArrow(run, schema)

    def described(self) -> DataFrame:
        """One row per node: component, depth, top, path (node first), on_cycle, cycle (least node of its group)."""

        def emit(walk: Walk) -> Iterator[pa.Table]:
            for lo in range(0, walk.n, BLOCK):
                own = slice(lo, min(lo + BLOCK, walk.n))
                paths = [walk.names[walk.path(v)] for v in range(own.start, own.stop)]
                yield pa.table(
                    {"node": walk.names[own], "component": np.zeros(len(paths), "i8"), "depth": walk.depth[own].astype("i4"), "top": np.array([x[-1] for x in paths], "i8"), "path": _lists(map(len, paths), np.concatenate(paths)),
                     "on_cycle": walk.on_cycle[own], "cycle": pa.array(walk.names[walk.group[own]], "i8", mask=~walk.on_cycle[own])}
                )

        out = self._walked(NODES, emit)
        if self.has_big:
            out = out.unionByName(big_described(self.big).select(*NODES.names))
        return self.nodes.join(out.drop("component"), "node", "left").select(
            "node", "component", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("top", "node").alias("top"),
            F.coalesce("path", F.array("node")).alias("path"), F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"), "cycle",
        )

    def cycles(self) -> DataFrame:
        """(node, cycle) of the nodes on cycles; ``cycle`` is the least node of the cycle group."""
        out = self._walked(T.StructType([NODES["node"], NODES["cycle"]]), _cyclic)
        if self.has_big:
            out = out.unionByName(cycle_groups(self.big).select("node", "cycle"))
        return out

    def back_links(self) -> DataFrame:
        """(child, parent) of the links inside a cycle group that do not lower the depth."""

        def emit(walk: Walk) -> Iterator[pa.Table]:
            child, parent = walk.names[walk.back]
            yield pa.table({"child": child, "parent": parent})

        out = self._walked(BACK, emit)
        if self.has_big:
            out = out.unionByName(_kept_links(self.big)[1].select("child", "parent"))
        return out

    def descendants(self) -> DataFrame:
        """(node, descendants): every node that others reach, with all of them in ascending order."""
        parents = self.links.select(F.col("parent").alias("node"), "component").distinct()
        out = self._shared(parents, BELOW, lambda walk, nodes: _relatives(walk, nodes, True), False)
        if self.has_big:
            out = out.unionByName(_gathered(closure(self.big).toDF("descendant", "node"), "descendant", "descendants"))
        return out

    def ancestors(self, seeds: DataFrame) -> DataFrame:
        """(node, ancestors) of the ``seeds`` (node) that reach others, with all of those in ascending order; components without a seed are left out."""
        wanted = seeds.select("node").dropna().distinct().join(self.nodes, "node")
        schema = T.StructType([BELOW["node"], T.StructField("ancestors", BELOW["descendants"].dataType)])
        out = self._shared(wanted, schema, lambda walk, nodes: _relatives(walk, nodes, False), False)
        if self.has_big:
            out = out.unionByName(_gathered(closure(self.big, wanted.select("node")).toDF("node", "ancestor"), "ancestor", "ancestors"))
        return out

    def paths(self) -> DataFrame:
        """(node, top, path) for every path of every node to a top; nodes that are tops have the path of themselves."""

        def emit(walk: Walk, own: np.ndarray) -> Iterator[pa.Table]:
            nodes, lengths, flat = [], [], []

            def ready() -> pa.Table:
                steps, sizes = walk.names[np.array(flat, "i8")], np.array(lengths, "i8")
                return pa.table({"node": walk.names[np.array(nodes, "i8")], "top": steps[np.cumsum(sizes) - 1], "path": _lists(sizes, steps)})

            for v in own.tolist():
                for path in walk.paths(v):
                    nodes.append(v)
                    lengths.append(len(path))
                    flat.extend(path)
                    if len(flat) >= CHUNK:
                        yield ready()
                        nodes, lengths, flat = [], [], []
            if nodes:
                yield ready()

        linked = self.links.select(F.explode(F.array("child", "parent")).alias("node"), "component").distinct()
        out = self._shared(linked, PATHS, emit, True)
        if self.has_big:
            out = out.unionByName(big_paths(self.big))
        alone = self.nodes.join(linked, "node", "left_anti").select("node", F.col("node").alias("top"), F.array("node").alias("path"))
        return out.unionByName(alone)


def _relatives(walk: Walk, nodes: np.ndarray, down: bool) -> Iterator[pa.Table]:
    for own, counts, others in walk.related(nodes, down):
        yield pa.table([pa.array(walk.names[own]), _lists(counts, walk.names[others])], names=["node", "descendants" if down else "ancestors"])


def _gathered(pairs: DataFrame, other: str, name: str) -> DataFrame:
    return pairs.groupBy("node").agg(F.sort_array(F.collect_list(other)).alias(name))


def _lists(lengths: Iterable[int], values: np.ndarray) -> pa.Array:
    """An array of lists of the given lengths."""
    ends = np.cumsum([0, *lengths])
    return pa.ListArray.from_arrays(pa.array(ends, "i4"), pa.array(values, "i8"))


def _cyclic(walk: Walk) -> Iterator[pa.Table]:
    on = walk.on_cycle
    yield pa.table({"node": walk.names[on], "cycle": walk.names[walk.group[on]]})


# ---- components beyond the bound: distributed rounds over written tables ----


def _jumped(jumps: DataFrame, **merged: Callable[[Column, Column], Column]) -> DataFrame:
    """Follow (node, to) by pointer jumping until no ``to`` is itself a node, in about log2 of the longest way.

    ``merged`` combines further columns of a node (a) and of the node it points
    to (b). Nodes that lead round in a circle keep a ``to`` that is a node; their
    columns have then met all of the circle.
    """
    jumps = cut(jumps, "jumps")
    count = jumps.count()
    for _ in range(count.bit_length() + 1):
        a, b = jumps.alias("a"), jumps.alias("b")
        columns = [f(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c, f in merged.items()]
        met = F.col("b.node").isNotNull()
        after = cut(a.join(b, F.col("a.to") == F.col("b.node"), "left").select("a.node", F.coalesce("b.to", "a.to").alias("to"), *columns, met.alias("_met")), "jumps")
        moved = not after.where("_met").isEmpty()
        drop(jumps)
        jumps = after.drop("_met")
        jumps._kinvote_path = after._kinvote_path
        if not moved:
            break
    return jumps


def _middles(links: DataFrame) -> DataFrame:
    """(node, up, down) of the nodes with exactly one parent and one child."""
    ups = links.groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("up"), F.count(F.lit(1)).alias("n")).where("n = 1").select("node", "up")
    downs = links.groupBy(F.col("parent").alias("node")).agg(F.min("child").alias("down"), F.count(F.lit(1)).alias("n")).where("n = 1").select("node", "down")
    return ups.join(downs, "node")


def _least(a: Column, b: Column) -> Column:
    return F.least(a, F.coalesce(b, a))


def _shortened(links: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(links, ways, circles): chains of nodes with one parent and one child become one link.

    ``ways`` (node, top, bottom) has what lies above and below the chain of each
    left-out node, ``circles`` (node, cycle) the circles made of such nodes alone.
    """
    middles = cut(_middles(links), "middles")
    if middles.isEmpty():
        return links, None, None
    up = _jumped(middles.select("node", F.col("up").alias("to"), F.col("node").alias("least")), least=_least)
    down = _jumped(middles.select("node", F.col("down").alias("to")))
    names = middles.select(F.col("node").alias("to"))
    circles = cut(up.join(names, "to", "left_semi").select("node", F.col("least").alias("cycle")), "circles")
    ways = cut(up.select("node", F.col("to").alias("top")).join(down.select("node", F.col("to").alias("bottom")), "node").join(circles, "node", "left_anti"), "ways")
    rest = links.join(middles.select(F.col("node").alias("child")), "child", "left_anti").join(circles.select(F.col("node").alias("parent")), "parent", "left_anti")
    passed = rest.join(ways.select(F.col("node").alias("parent"), "top"), "parent", "left").select("child", F.coalesce("top", "parent").alias("parent"))
    return cut(passed.distinct(), "short"), ways, circles


def _core(links: DataFrame) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """(links, ways, groups): what is left when ends are taken off and chains shortened in turn, until neither changes anything.

    Each round takes off the nodes without parents or children, which are on no
    cycle, and then shortens the chains that this leaves, so trees of any depth
    vanish in few rounds.
    """
    links = cut(links.select("child", "parent").distinct(), "core")
    ways, groups, count = [], [], links.count()
    while count:
        groups.append(links.where("child = parent").select(F.col("child").alias("node"), F.col("child").alias("cycle")))
        real = links.where("child <> parent")
        inner = cut(real.select(F.col("child").alias("node")).intersect(real.select(F.col("parent").alias("node"))), "inner")
        less = real.join(inner.withColumnRenamed("node", "child"), "child", "left_semi").join(inner.withColumnRenamed("node", "parent"), "parent", "left_semi")
        links, way, circles = _shortened(cut(less.select("child", "parent"), "core"))
        if way is not None:
            ways.append(way)
            groups.append(circles)
        left = links.count()
        if left == count:
            break
        count = left
    return links, ways, groups


def _spread_least(links: DataFrame, labels: DataFrame, source: str, target: str) -> DataFrame:
    """Labels (node, label) spread along links from ``source`` to ``target`` until each node has the least that reaches it."""
    while True:
        sent = links.join(labels.withColumnRenamed("node", source), source).groupBy(F.col(target).alias("node")).agg(F.min("label").alias("got"))
        new = cut(labels.join(sent, "node", "left").select("node", F.least("label", F.coalesce("got", "label")).alias("label"), (F.col("got") < F.col("label")).alias("changed")), "labels")
        changed = new.where("changed").limit(1).count()
        drop(labels)
        labels = new.select("node", "label")
        labels._kinvote_path = new._kinvote_path
        if not changed:
            return labels


def _merged(groups: list[DataFrame]) -> DataFrame:
    """(node, cycle): groups that share a node become one, named by its least node."""
    pairs = groups[0]
    for x in groups[1:]:
        pairs = pairs.unionByName(x)
    pairs = cut(pairs.distinct(), "groups")
    own = components(pairs.select(F.col("node").alias("u"), F.col("cycle").alias("v")))
    return cut(pairs.select("node").distinct().join(own, "node", "left").select("node", F.coalesce("root", "node").alias("cycle")), "groups")


def cycle_groups(links: DataFrame) -> DataFrame:
    """(node, cycle) of all nodes on cycles of ``links``, in distributed rounds.

    Ends are taken off and chains shortened first (``_core``). In what is left
    every node takes the least node that reaches it upwards as its colour; the
    nodes that reach their colour's node inside the colour form its cycle
    group. Found groups are taken out and the rest goes on. At last the nodes of
    a chain between two nodes of one group are put into it.
    """
    rest, ways, groups = _core(links)
    while not rest.isEmpty():
        start = rest.select(F.explode(F.array("child", "parent")).alias("node")).distinct().select("node", F.col("node").alias("label"))
        colour = _spread_least(rest, cut(start, "colour"), "child", "parent")
        inside = rest.join(colour.select(F.col("node").alias("child"), F.col("label").alias("a")), "child").join(colour.select(F.col("node").alias("parent"), F.col("label").alias("b")), "parent").where("a = b")
        inside = cut(inside.select("child", "parent"), "inside")
        # From the colour's own node down: who reaches it within the colour.
        marks = cut(colour.select("node", F.when(F.col("node") == F.col("label"), F.lit(0)).otherwise(F.lit(1)).alias("label")), "marks")
        reached = _spread_least(inside, marks, "parent", "child").where("label = 0").select("node")
        group = cut(colour.join(reached, "node").select("node", F.col("label").alias("cycle")), "group")
        several = group.join(group.groupBy("cycle").count().where("count > 1").select("cycle"), "cycle", "left_semi").select("node", "cycle")
        groups.append(several)
        gone = group.select("node")
        rest, more, found = _core(rest.join(gone.withColumnRenamed("node", "child"), "child", "left_anti").join(gone.withColumnRenamed("node", "parent"), "parent", "left_anti"))
        ways, groups = ways + more, groups + found
    if not groups:
        return links.select(F.col("child").alias("node"), F.col("child").alias("cycle")).limit(0)
    found = _merged(groups)
    for way in reversed(ways):
        ends = way.join(found.select(F.col("node").alias("top"), F.col("cycle").alias("a")), "top").join(found.select(F.col("node").alias("bottom"), F.col("cycle").alias("b")), "bottom")
        ends = cut(ends.where("a = b").select("node", F.col("a").alias("cycle")), "ends")
        # A node of the chain that was known so far links to itself and is now in a larger group.
        found = cut(found.join(ends, "node", "left_anti").unionByName(ends), "groups")
    least = found.groupBy("cycle").agg(F.min("node").alias("least"))
    return cut(found.join(least, "cycle").select("node", F.col("least").alias("cycle")), "cycles")


def big_depths(links: DataFrame) -> DataFrame:
    """(node, group, cycle, depth) of all nodes of ``links``; ``group`` is the node itself off the cycles.

    Nodes with one parent jump to the next node above that has none or several;
    only those with several are then lowered round by round, as often as they
    follow each other on a shortest way.
    """
    cycles = cycle_groups(links)
    nodes = cut(links.select(F.explode(F.array("child", "parent")).alias("node")).distinct().join(cycles, "node", "left").withColumn("group", F.coalesce("cycle", "node")), "big-nodes")
    group = nodes.select("node", "group")
    placed = links.join(group.toDF("child", "a"), "child").join(group.toDF("parent", "b"), "parent")
    leaving = placed.where("a <> b").select(F.col("a").alias("node")).distinct()
    tops = cut(nodes.where("node = group").select("node").join(leaving, "node", "left_anti"), "tops")
    links = cut(links.join(tops.select(F.col("node").alias("child")), "child", "left_anti").where("child <> parent").select("child", "parent"), "upward")
    each = cut(links.groupBy("child").agg(F.min("parent").alias("parent"), F.count(F.lit(1)).alias("n")), "parents")
    single = _jumped(each.where("n = 1").select(F.col("child").alias("node"), F.col("parent").alias("to"), F.lit(1).alias("steps")), steps=lambda a, b: a + F.coalesce(b, F.lit(0)))
    above = links.join(each.where("n > 1").select("child"), "child", "left_semi").join(single.toDF("parent", "to", "steps"), "parent", "left")
    above = cut(above.groupBy("child", F.coalesce("to", "parent").alias("anchor")).agg(F.min(F.coalesce("steps", F.lit(0)) + 1).alias("steps")), "anchors")
    depth = cut(tops.select("node", F.lit(0).alias("depth")), "depths")
    while True:
        reached = above.join(depth.toDF("anchor", "up"), "anchor").groupBy(F.col("child").alias("node")).agg(F.min(F.col("steps") + F.col("up")).alias("got"))
        after = cut(depth.join(reached, "node", "full").select("node", F.least("depth", "got").alias("depth"), (F.col("depth").isNull() | (F.col("got") < F.col("depth"))).alias("changed")), "depths")
        changed = not after.where("changed").isEmpty()
        drop(depth)
        depth = after.select("node", "depth")
        depth._kinvote_path = after._kinvote_path
        if not changed:
            break
    hung = single.join(depth.toDF("to", "up"), "to").select("node", (F.col("steps") + F.col("up")).alias("depth"))
    return cut(nodes.join(depth.unionByName(hung), "node"), "said")


def big_described(links: DataFrame) -> DataFrame:
    """What ``Hierarchy.described`` says: the least parent one level up leads, and paths grow by doubling."""
    links = cut(links.select("child", "parent").distinct(), "big-links")
    said = big_depths(links)
    depth = said.select("node", "depth")
    leads = links.join(depth.toDF("child", "a"), "child").join(depth.toDF("parent", "b"), "parent").where("b = a - 1").groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("to"))
    paths = _jumped(leads.select("node", "to", F.array("node").alias("path")), path=lambda a, b: F.concat(a, F.coalesce(b, F.array().cast("array<bigint>"))))
    out = said.join(paths, "node", "left").select("node", "depth", F.coalesce("to", "node").alias("top"), F.when(F.col("to").isNull(), F.array("node")).otherwise(F.concat("path", F.array("to"))).alias("path"), "cycle")
    return out.select("node", F.lit(0).cast("long").alias("component"), "depth", "top", "path", F.col("cycle").isNotNull().alias("on_cycle"), "cycle")


def _kept_links(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links that paths may use, the others)."""
    links = cut(links.select("child", "parent").distinct(), "big-links")
    said = big_depths(links).select("node", "depth", "group")
    c, p = said.toDF("child", "cd", "cg"), said.toDF("parent", "pd", "pg")
    both = links.join(c, "child").join(p, "parent")
    keep = (F.col("cg") != F.col("pg")) | (F.col("pd") < F.col("cd"))
    return both.where(keep).select("child", "parent"), both.where(~keep).select("child", "parent")


def closure(links: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(node, ancestor) of all nodes, or of ``seeds`` (node), by doubling.

    Round r knows the pairs of up to 2^r steps and those of exactly 2^r; joining
    the two gives those of up to 2^(r+1). It ends when a round adds none, after
    about log2 of the longest way.
    """
    links = cut(links.select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).distinct(), "ways")
    exactly, known = links, links if seeds is None else cut(links.join(seeds, "node", "left_semi"), "ancestors")
    while True:
        further = known.withColumnRenamed("ancestor", "middle").join(exactly.withColumnRenamed("node", "middle"), "middle").select("node", "ancestor").distinct()
        new = cut(further.join(known, ["node", "ancestor"], "left_anti"), "ancestors")
        if new.isEmpty():
            return known.where("node <> ancestor")
        known = cut(known.unionByName(new), "ancestors")
        exactly = cut(exactly.withColumnRenamed("ancestor", "middle").join(exactly.withColumnRenamed("node", "middle"), "middle").select("node", "ancestor").distinct(), "ways")


def big_paths(links: DataFrame) -> DataFrame:
    """All paths, longer by one link each round."""
    kept = cut(_kept_links(links)[0], "kept")
    nodes = links.select(F.explode(F.array("child", "parent")).alias("node")).distinct()
    tops = nodes.join(kept.select(F.col("child").alias("node")).distinct(), "node", "left_anti")
    new = cut(tops.select("node", F.col("node").alias("top"), F.array("node").alias("path")), "paths")
    every = new
    while new.limit(1).count():
        new = cut(kept.join(new.withColumnRenamed("node", "parent"), "parent").select(F.col("child").alias("node"), "top", F.concat(F.array("child"), "path").alias("path")), "paths")
        every = every.unionByName(new)
    return every
