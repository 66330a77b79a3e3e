"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinvote.functions import clean
from kinvote.llm import cutoff, mixing, nearest, packing, splits, stuffing, top_n
from kinvote.sources.scratch import cut
from kinvote.sources.tables import table


def p1_found(spark, at):
    return top_n.top_terms(table(spark, at, "predictions")).select("protein_accession", "go_term_id")


def p1_top_terms(spark, at):
    return top_n.top_terms(table(spark, at, "predictions"))


def p2_found(spark, at):
    return cutoff.aspect_cutoffs(table(spark, at, "predictions"))[0].select("prediction_id")


def p2_cutoffs(spark, at):
    return cutoff.aspect_cutoffs(table(spark, at, "predictions"))[1].select("aspect", "cutoff", "total", "kept")


def p3_found(spark, at):
    return splits.split_training_rows(table(spark, at, "training_rows")).where("group_size >= 2").select("example_id", "group_id")


def p3_splits(spark, at):
    return splits.split_training_rows(table(spark, at, "training_rows"))


def p5_found(spark, at):
    return nearest.most_similar(table(spark, at, "queries"), table(spark, at, "refs")).select("query_pos", "ref_accession")


def p5_neighbours(spark, at):
    out = nearest.most_similar(table(spark, at, "queries"), table(spark, at, "refs"))
    return out.select("query_pos", "ref_accession", "rank", F.round("distance", 6).alias("distance"))


def p7_found(spark, at):
    return packing.oversized(table(spark, at, "documents"))


def p7_containers(spark, at):
    return packing.pack_documents(table(spark, at, "documents"))


def p7_report(spark, at):
    items = cut(packing.sized_documents(table(spark, at, "documents")), "tokens")
    return packing.container_report(items, cut(packing.fill_containers(items), "containers"))


def p7_check(spark, at):
    """Whether all texts are in containers whole, none is overfull, none was cut without need, and under 1 % more are used than any packing needs (3 at least)."""
    fine = {"whole": "lost = 0", "fits": "overfull = 0 and misstated = 0", "uncut": "cut_needlessly = 0", "full": "containers <= least + greatest(3, least * 0.01)"}
    return p7_report(spark, at).select(*[F.expr(x).alias(c) for c, x in fine.items()])


def p8_found(spark, at):
    return mixing.mix_documents(table(spark, at, "documents"), table(spark, at, "mix_targets"))[1].where("short").select("source")


def p8_report(spark, at):
    return mixing.mix_documents(table(spark, at, "documents"), table(spark, at, "mix_targets"))[1]


def p8_uses(spark, at):
    return mixing.mix_documents(table(spark, at, "documents"), table(spark, at, "mix_targets"))[0]


def p8_check(spark, at):
    """Per source whether its uses have its budget exactly, or all repeats of all its tokens, and no document is used more often than allowed."""
    uses, report = mixing.mix_documents(table(spark, at, "documents"), table(spark, at, "mix_targets"))
    most = uses.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("epoch").alias("epochs")).groupBy("source").agg(F.max("n").alias("n"), F.count_if(F.col("n") != F.col("epochs")).alias("twice"))
    got = uses.groupBy("source").agg(F.sum("n_tokens").alias("got"))
    rows = report.join(got, "source", "left").join(most, "source", "left")
    budget = F.coalesce("got", F.lit(0)) == F.least("budget", F.col("max_repeats") * F.col("own_tokens"))
    return rows.select("source", budget.alias("on_budget"), (F.coalesce("n", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"), (F.coalesce("twice", F.lit(0)) == 0).alias("once_an_epoch"))


def p3_check(spark, at):
    """Whether every group is in one split, and each split has its share of the rows (within the largest group) and of the positive labels (within 2 % of all rows and the largest group)."""
    rows = cut(p3_splits(spark, at), "splits")
    labels = table(spark, at, "training_rows").groupBy("example_id").agg(F.max("label").alias("label"))
    groups = rows.groupBy("group_id").agg(F.countDistinct("split").alias("k"), F.count(F.lit(1)).alias("n"))
    total = groups.agg(F.max("k").alias("k"), F.max("n").alias("most"), F.sum("n").alias("total"))
    by = rows.join(labels, "example_id").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("ones"))
    share = F.create_map(*[F.lit(x) for pair in splits.SPLITS.items() for x in pair])[F.col("split")]
    every = by.agg(F.sum("ones").alias("all_ones"))
    return by.join(F.broadcast(total)).join(F.broadcast(every)).select(
        "split", (F.col("k") == 1).alias("whole_groups"), (F.abs(F.col("n") - share * F.col("total")) <= F.col("most")).alias("share_met"),
        (F.abs(F.col("ones") - share * F.col("all_ones")) <= F.col("most") + 0.02 * F.col("total")).alias("labels_met"),
    )


def p9_found(spark, at):
    return stuffing.stuffed(table(spark, at, "documents")).select("doc_id")


def p9_lines(spark, at):
    out = stuffing.judged(table(spark, at, "documents").select("doc_id", "text"))
    return out.withColumn("stuffed_share", F.round("stuffed_share", 6))


_BEST = r"""
WITH b AS (SELECT upper(trim(protein_accession, ' ' || chr(9) || chr(10) || chr(13))) protein_accession, go_term_id, max(reranker_score) reranker_score
           FROM predictions WHERE NOT isnan(reranker_score) AND reranker_score BETWEEN 0 AND 1 GROUP BY 1, 2),
     r AS (SELECT *, row_number() OVER (PARTITION BY protein_accession ORDER BY reranker_score DESC, go_term_id) AS position
           FROM b WHERE protein_accession <> '' AND go_term_id IS NOT NULL)
"""
_SCORED = r"""
WITH n AS (SELECT prediction_id, reranker_score s, lower(trim(aspect, ' ' || chr(9) || chr(10) || chr(13))) a FROM predictions
           WHERE NOT isnan(reranker_score) AND reranker_score BETWEEN 0 AND 1 AND prediction_id IS NOT NULL),
     m AS (SELECT prediction_id, s, CASE WHEN a IN ('f', 'molecular_function', 'molecular function') THEN 'F'
                  WHEN a IN ('p', 'biological_process', 'biological process') THEN 'P'
                  WHEN a IN ('c', 'cellular_component', 'cellular component') THEN 'C' END aspect FROM n),
     d AS (SELECT prediction_id, min(aspect) aspect, max(s) s FROM m WHERE aspect IS NOT NULL GROUP BY 1),
     r AS (SELECT *, row_number() OVER (PARTITION BY aspect ORDER BY s DESC) i, count(*) OVER (PARTITION BY aspect) total FROM d),
     k AS (SELECT aspect, total, s AS cutoff FROM r WHERE i = ceil(total * CASE aspect WHEN 'F' THEN 0.30 WHEN 'P' THEN 0.15 ELSE 0.45 END))
"""

_TIED = r"""
WITH RECURSIVE c AS (SELECT example_id id, lower(trim(seq_checksum, ' ' || chr(9) || chr(10) || chr(13))) k FROM training_rows),
     k AS (SELECT example_id id, 'a' || upper(regexp_extract(protein_accession, '[A-Za-z][0-9]{8}')) k FROM training_rows
           WHERE regexp_matches(protein_accession, '[A-Za-z][0-9]{8}')
           UNION SELECT id, 'c' || k FROM c WHERE k <> '' AND NOT regexp_full_match(k, '0+|-+|_+|\.+') AND k NOT IN (NO_VALUE)),
     e AS (SELECT DISTINCT a.id x, b.id y FROM k a JOIN k b USING (k)),
     r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT x example_id, min(y) group_id FROM r GROUP BY 1 HAVING count(DISTINCT y) >= 2
""".replace("NO_VALUE", ", ".join(f"'{w}'" for w in clean.NO_VALUE))
_NEAREST = r"""
WITH q AS (SELECT query_pos, embedding::DOUBLE[] v FROM queries WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
     r AS (SELECT ref_accession, embedding::DOUBLE[] v FROM refs WHERE ref_accession IS NOT NULL AND len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
     d AS (SELECT query_pos, ref_accession, min(1 - list_cosine_similarity(q.v, r.v)) distance FROM q, r GROUP BY 1, 2),
     n AS (SELECT *, row_number() OVER (PARTITION BY query_pos ORDER BY distance, ref_accession) rank FROM d)
"""

QUERIES = {"p1_found": p1_found, "p1_top_terms": p1_top_terms, "p2_found": p2_found, "p2_cutoffs": p2_cutoffs,
    "p3_found": p3_found, "p3_splits": p3_splits, "p3_check": p3_check, "p5_found": p5_found, "p5_neighbours": p5_neighbours, "p9_found": p9_found, "p9_lines": p9_lines,
    "p7_found": p7_found, "p7_containers": p7_containers, "p7_report": p7_report, "p7_check": p7_check, "p8_found": p8_found, "p8_report": p8_report, "p8_uses": p8_uses, "p8_check": p8_check}
SQL = {
    "p1_found": _BEST + "SELECT protein_accession, go_term_id FROM r WHERE position <= 5",
    "p1_top_terms": _BEST + "SELECT * FROM r WHERE position <= 5",
    "p2_found": _SCORED + "SELECT prediction_id FROM d JOIN k USING (aspect) WHERE d.s >= k.cutoff",
    "p2_cutoffs": _SCORED + "SELECT aspect, cutoff, any_value(total) total, count(*) kept FROM d JOIN k USING (aspect) WHERE d.s >= k.cutoff GROUP BY 1, 2",
    "p3_found": _TIED,
    "p3_check": "SELECT *, true whole_groups, true share_met, true labels_met FROM (VALUES ('train'), ('validation'), ('test')) v(split)",
    "p7_check": "SELECT true whole, true fits, true uncut, true AS full",
    "p8_check": "SELECT source, true on_budget, true within_repeats, true once_an_epoch FROM mix_targets",
    "p5_found": _NEAREST + "SELECT query_pos, ref_accession FROM n WHERE rank <= 5",
    "p5_neighbours": _NEAREST + "SELECT query_pos, ref_accession, rank, round(distance, 6) distance FROM n WHERE rank <= 5",
}
