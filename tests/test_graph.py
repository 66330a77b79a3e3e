"""Components and hierarchies against plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest
from kinvote.operators import hierarchy
from kinvote.operators.components import components, forest
from kinvote.operators.hierarchy import Hierarchy, Walk, term_links
from pyspark.sql import functions as F


def brute_components(edges):
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {x: find(x) for x in top}


def brute(links):
    """(reach, depth, cyclic) of the distinct links child -> parent."""
    nodes = sorted({x for e in links for x in e})
    up = {x: sorted({p for c, p in links if c == x}) for x in nodes}
    reach = {}
    for x in nodes:
        seen, todo = set(), list(up[x])
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                todo.extend(up[y])
        reach[x] = seen
    group = {x: min([y for y in reach[x] if x in reach[y]] + [x]) for x in nodes}
    tops = {x for x in nodes if group[x] == x and all(group[p] == x for y in nodes if group[y] == x for p in up[y])}
    depth, path, level = {t: 0 for t in tops}, {t: [t] for t in tops}, sorted(tops)
    while level:
        below = {}
        for x in nodes:
            if x not in depth:
                by = [p for p in up[x] if p in level]
                if by:
                    below[x] = min(by)
        for x, p in below.items():
            depth[x], path[x] = depth[p] + 1, [x, *path[p]]
        level = sorted(below)
    kept = {x: [p for p in up[x] if group[p] != group[x] or depth[p] < depth[x]] for x in nodes}

    def paths(x):
        return [[x, *rest] for p in kept[x] for rest in paths(p)] or [[x]]

    return reach, depth, path, {x: group[x] for x in nodes if x in reach[x]}, {x: paths(x) for x in nodes}


def graph(seed, n=40, m=60):
    r = random.Random(seed)
    links = [(r.randrange(1, n), r.randrange(1, n)) for _ in range(m // 4)]
    links += [(b, a) for a, b in (sorted(r.sample(range(n, 2 * n), 2)) for _ in range(m // 2))]
    return links + links[:5] + [(200, 200), (300, 301), (301, 302), (302, 300)]


def check(spark, links, **options):
    rows = spark.createDataFrame([(c, p) for c, p in links], "child long, parent long")
    nodes = spark.createDataFrame([(999,)], "node long")
    h = Hierarchy(rows, nodes, **options)
    reach, depth, path, cyclic, paths = brute(set(links))
    said = {r["node"]: r for r in h.described().collect()}
    assert set(said) == {*depth, 999}
    assert {x: said[x]["depth"] for x in depth} == depth
    assert {x: said[x]["path"] for x in depth} == path
    assert {x: said[x]["cycle"] for x in said if said[x]["on_cycle"]} == cyclic
    assert said[999]["path"] == [999] and said[999]["component"] == 999
    assert {r["node"]: r["cycle"] for r in h.cycles().collect()} == cyclic
    below = {r["node"]: r["descendants"] for r in h.descendants().collect()}
    want = {x: sorted(y for y in depth if y != x and x in reach[y]) for x in depth}
    assert below == {x: v for x, v in want.items() if v}
    got = {}
    for r in h.paths().collect():
        got.setdefault(r["node"], []).append(r["path"])
        assert r["top"] == r["path"][-1]
    assert {x: sorted(v) for x, v in got.items()} == {**{x: sorted(v) for x, v in paths.items()}, 999: [[999]]}
    back = {tuple(r) for r in h.back_links().collect()}
    assert back == {(c, p) for c, p in set(links) if c in cyclic and cyclic[c] == cyclic.get(p) and depth[p] >= depth[c]}
    seeds = [x for x in depth if x % 3 == 0]
    above = {r["node"]: r["ancestors"] for r in h.ancestors(spark.createDataFrame([(x,) for x in [*seeds, None, 12345]], "node long")).collect()}
    assert above == {x: sorted(reach[x] - {x}) for x in seeds if reach[x] - {x}}


def test_hierarchy_in_memory(spark):
    check(spark, graph(1))


@pytest.mark.parametrize("max_links", [1, 4])
def test_hierarchy_distributed_has_the_same_definitions(spark, max_links):
    check(spark, graph(2, 14, 30), max_links=max_links)


def test_large_components_are_shared_between_tasks(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "BLOCK", 5)
    monkeypatch.setattr(hierarchy, "CHUNK", 7)
    check(spark, graph(4))


@pytest.mark.parametrize("max_links", [3, 1000])
def test_back_links_do_not_depend_on_the_bound(spark, max_links):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 9)], "child long, parent long")
    h = Hierarchy(links, spark.createDataFrame([], "node long"), max_links)
    assert [tuple(r) for r in h.back_links().collect()] == [(1, 2)]


def test_hierarchy_of_nothing(spark):
    h = Hierarchy(spark.createDataFrame([], "child long, parent long"), spark.createDataFrame([], "node long"))
    assert not h.described().count() + h.cycles().count() + h.descendants().count() + h.paths().count() + h.back_links().count()


def test_relatives_agree_with_plain_python():
    links = sorted(set(graph(5)))
    reach = brute(set(links))[0]
    walk = Walk(*np.array(links).T, full=False)
    for down in (False, True):
        got = {}
        for nodes, counts, others in walk.related(np.arange(walk.n), down):
            for v, own in zip(walk.names[nodes], np.split(walk.names[others], np.cumsum(counts)[:-1])):
                got[int(v)] = own.tolist()
        want = {x: sorted(y for y in reach if y != x and (x in reach[y] if down else y in reach[x])) for x in reach}
        assert got == {x: v for x, v in want.items() if v}


def test_many_random_graphs_beyond_the_bound(spark):
    """Sparse, layered and circular graphs side by side, against the walk in memory."""
    links = set()
    for g in range(150):
        r = random.Random(g)
        n, style = r.randrange(2, 14), g % 3
        for _ in range(r.randrange(1, 3 * n)):
            a, b = r.randrange(n), r.randrange(n)
            if style == 1 and a < b and r.random() < 0.9:
                a, b = b, a
            if style == 2 and r.random() < 0.8:
                b = (a + 1) % n
            links.add((g * 100 + a, g * 100 + b))
    walk = Walk(*np.array(sorted(links)).T)
    rows = spark.createDataFrame(sorted(links), "child long, parent long")
    name = walk.names.tolist()
    cyclic = {name[i]: name[walk.group[i]] for i in range(walk.n) if walk.on_cycle[i]}
    got = {r["node"]: (r["depth"], r["path"], r["cycle"]) for r in hierarchy.big_described(rows).collect()}
    assert got == {name[i]: (int(walk.depth[i]), [name[x] for x in walk.path(i)], cyclic.get(name[i])) for i in range(walk.n)}
    assert {tuple(r) for r in hierarchy._kept_links(rows)[1].collect()} == {(name[c], name[p]) for c, p in walk.back.T}


def test_cycles_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    """100,000 steps with side branches and two cycles, one of them as long as half the chain."""
    n, tables, cut = 100_000, [], hierarchy.cut
    monkeypatch.setattr(hierarchy, "cut", lambda *a: tables.append(a[1]) or cut(*a))
    chain = spark.range(n).select(F.col("id").alias("child"), (F.col("id") + 1).alias("parent"))
    sides = spark.range(0, n, 7).select((F.col("id") + 10 * n).alias("child"), F.col("id").alias("parent"))
    circles = spark.createDataFrame([(n // 2, 5), (n - 10, n - 20)], "child long, parent long")
    h = Hierarchy(chain.unionByName(sides).unionByName(circles), spark.createDataFrame([], "node long"), max_links=1000)
    got = h.cycles().groupBy("cycle").count().collect()
    assert {(r["cycle"], r["count"]) for r in got} == {(5, n // 2 - 4), (n - 20, 11)}
    assert [tuple(r) for r in h.back_links().orderBy("child").collect()] == [(n // 2, 5), (n - 10, n - 20)]
    assert len(tables) < 250


def test_back_links_close_every_cycle(spark):
    links = set(graph(3))
    h = Hierarchy(spark.createDataFrame(list(links), "child long, parent long"), spark.createDataFrame([], "node long"))
    back = {tuple(r) for r in h.back_links().collect()}
    assert back <= links and not brute(links - back)[3]


def test_term_links_read_every_notation(spark):
    rows = [("GO:0000005", " go:7\t"), ("GO_5", "GO:0000007"), ("GO:0000007", None), ("GO:9", ""), (None, "GO:1"), ("none", "GO:1"), ("GO:9", "GO:9")]
    links, nodes = term_links(spark.createDataFrame([(*r, "is_a", 1) for r in rows], "go_id string, parent_id string, relation string, extra int"))
    assert sorted(tuple(r) for r in links.collect()) == [(5, 7), (9, 9)]
    assert sorted(r[0] for r in nodes.collect()) == [1, 5, 7, 9]


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)] + [(70, 71), (71, 72)], [(3, 3), (None, 2), (5, 4), (4, 5), (5, 4)], []])
def test_components(spark, edges):
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    for task_links in (1_000_000, 17):  # one part, and several that are joined by stars
        got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long"), task_links).collect()}
        assert got == brute_components(real)


def test_components_of_a_shuffled_chain(spark):
    order = list(range(300))
    random.Random(4).shuffle(order)
    edges = list(zip(order, order[1:]))
    for task_links in (1_000_000, 60):
        assert {r["root"] for r in components(spark.createDataFrame(edges, "u long, v long"), task_links).collect()} == {0}


@pytest.mark.parametrize("seed", range(8))
def test_forest(seed):
    r = random.Random(seed)
    edges = [(r.randrange(90), r.randrange(90)) for _ in range(seed * 15)]
    nodes, roots = forest(*(np.array([e[i] for e in edges], "i8") for i in (0, 1)))
    assert dict(zip(nodes.tolist(), roots.tolist())) == brute_components(edges)
