"""Queries of the term hierarchy."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinvote.functions import clean
from kinvote.operators.hierarchy import Hierarchy, term_links
from kinvote.sources.tables import table


def _hierarchy(spark, at):
    return Hierarchy(*term_links(table(spark, at, "term_parents")))


def _named(name):
    return clean.term_id(F.col(name))


def _path(name):
    return F.array_join(F.transform(name, clean.term_id), "/").alias(name)


def p4_found(spark, at):
    return _hierarchy(spark, at).cycles().select(_named("node").alias("go_id"))


def p4_terms(spark, at):
    return _hierarchy(spark, at).described().select(_named("node").alias("go_id"), "depth", _named("top").alias("top"), _path("path"), "on_cycle", _named("cycle").alias("cycle"))


def p4_paths(spark, at):
    return _hierarchy(spark, at).paths().select(_named("node").alias("go_id"), _named("top").alias("top"), (F.size("path") - 1).alias("steps"), _path("path"))


def p4_descendants(spark, at):
    return _hierarchy(spark, at).descendants().select(_named("node").alias("go_id"), F.size("descendants").cast("long").alias("n"), F.array_join(F.transform("descendants", clean.term_id), ",").alias("descendants"))


def p4_back_links(spark, at):
    return _hierarchy(spark, at).back_links().select(_named("child").alias("go_id"), _named("parent").alias("parent_id"))


_REACH = r"""
WITH RECURSIVE l AS (SELECT DISTINCT regexp_extract(go_id, '(\d+)', 1)::BIGINT c, regexp_extract(parent_id, '(\d+)', 1)::BIGINT p
                     FROM term_parents WHERE regexp_matches(go_id, '\d') AND regexp_matches(parent_id, '\d')),
     r AS (SELECT c, p FROM l UNION SELECT r.c, l.p FROM r JOIN l ON r.p = l.c)
"""

# Cycle groups (grp), depths by breadth first search and the links that paths may use.
_DEPTHS = (
    _REACH.rstrip()
    + r""",
     n AS (SELECT DISTINCT x::BIGINT x FROM (SELECT regexp_extract(go_id, '(\d+)', 1) x FROM term_parents UNION SELECT regexp_extract(parent_id, '(\d+)', 1) FROM term_parents) WHERE x <> ''),
     k AS (SELECT a.c x, min(a.p) y FROM r a JOIN r b ON a.c = b.p AND a.p = b.c GROUP BY 1),
     g AS (SELECT n.x, coalesce(y, n.x) grp, y AS cycle FROM n LEFT JOIN k ON k.x = n.x),
     o AS (SELECT DISTINCT a.grp FROM l JOIN g a ON a.x = l.c JOIN g b ON b.x = l.p WHERE a.grp <> b.grp),
     d(x, depth) USING KEY (x) AS (SELECT x, 0 FROM g WHERE x = grp AND grp NOT IN (SELECT grp FROM o)
       UNION SELECT DISTINCT l.c, d.depth + 1 FROM d JOIN l ON l.p = d.x WHERE l.c NOT IN (SELECT x FROM recurring.d)),
     w AS (SELECT l.c, l.p, a.grp = b.grp AND dp.depth >= dc.depth back FROM l JOIN g a ON a.x = l.c JOIN g b ON b.x = l.p JOIN d dc ON dc.x = l.c JOIN d dp ON dp.x = l.p)"""
)
_ID = "'GO:' || lpad({0}::VARCHAR, greatest(7, len({0}::VARCHAR))::INT, '0')"
_STEPS = f"list_aggregate(list_transform(path, lambda x: {_ID.format('x')}), 'string_agg', '/')"

QUERIES = {"p4_found": p4_found, "p4_terms": p4_terms, "p4_paths": p4_paths, "p4_descendants": p4_descendants, "p4_back_links": p4_back_links}
SQL = {
    "p4_found": _REACH + "SELECT 'GO:' || lpad(c::VARCHAR, 7, '0') go_id FROM r WHERE c = p",
    "p4_descendants": _REACH + "SELECT 'GO:' || lpad(p::VARCHAR, 7, '0') go_id, count(*) n, string_agg('GO:' || lpad(c::VARCHAR, 7, '0'), ',' ORDER BY c) descendants FROM r WHERE c <> p GROUP BY p",
    "p4_terms": _DEPTHS
    + f""", e AS (SELECT l.c, min(l.p) up FROM l JOIN d a ON a.x = l.c JOIN d b ON b.x = l.p WHERE b.depth = a.depth - 1 GROUP BY 1),
     t AS (SELECT x, x here, [x] path FROM g UNION ALL SELECT t.x, e.up, list_append(t.path, e.up) FROM t JOIN e ON e.c = t.here)
SELECT {_ID.format("g.x")} go_id, d.depth, {_ID.format("t.here")} top, {_STEPS} path, g.cycle IS NOT NULL on_cycle, {_ID.format("g.cycle")} AS cycle
FROM g JOIN d USING (x) JOIN t ON t.x = g.x AND t.here NOT IN (SELECT c FROM e)""",
    "p4_paths": _DEPTHS
    + f""", v AS (SELECT c, p FROM w WHERE NOT back),
     t AS (SELECT x, x here, [x] path FROM g UNION ALL SELECT t.x, v.p, list_append(t.path, v.p) FROM t JOIN v ON v.c = t.here)
SELECT {_ID.format("x")} go_id, {_ID.format("here")} top, len(path) - 1 steps, {_STEPS} path FROM t WHERE here NOT IN (SELECT c FROM v)""",
    "p4_back_links": _DEPTHS + f" SELECT {_ID.format('c')} go_id, {_ID.format('p')} parent_id FROM w WHERE back",
}
