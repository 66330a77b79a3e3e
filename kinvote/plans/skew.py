"""Queries of the skew-proof per-term results."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinvote.operators import skew
from kinvote.sources.tables import table


def p6_found(spark, at):
    return skew.heavy_terms(table(spark, at, "annotations"), table(spark, at, "predictions")).select("table_name", "go_term_id")


def p6_terms(spark, at):
    out = skew.term_results(table(spark, at, "annotations"), table(spark, at, "predictions"))
    return out.select("table_name", "go_term_id", "n_rows", "n_pairs", F.round("share", 9).alias("share"), "n_scored", "score_micros", "score_min", "score_max")


_PAIRS = r"""
WITH a AS (SELECT ref_accession k, go_term_id, count(*) n_rows, NULL::BIGINT n_scored, NULL::BIGINT s, NULL::DOUBLE lo, NULL::DOUBLE hi
           FROM annotations WHERE ref_accession IS NOT NULL AND go_term_id IS NOT NULL GROUP BY 1, 2),
     c AS (SELECT upper(trim(protein_accession, ' ' || chr(9) || chr(10) || chr(13))) k, go_term_id,
                  CASE WHEN NOT isnan(reranker_score) AND reranker_score BETWEEN 0 AND 1 THEN reranker_score END score FROM predictions),
     p AS (SELECT k, go_term_id, count(*) n_rows, count(score) n_scored, sum(round(score * 1000000)::BIGINT) s, min(score) lo, max(score) hi
           FROM c WHERE k <> '' AND go_term_id IS NOT NULL GROUP BY 1, 2),
     u AS (SELECT 'annotations' table_name, * FROM a UNION ALL SELECT 'predictions', * FROM p),
     t AS (SELECT table_name, go_term_id, sum(n_rows)::BIGINT n_rows, count(*) n_pairs, sum(n_scored)::BIGINT n_scored,
                  sum(s)::BIGINT s, min(lo) score_min, max(hi) score_max FROM u GROUP BY 1, 2),
     r AS (SELECT *, sum(n_pairs) OVER (PARTITION BY table_name) all_pairs FROM t)
"""

QUERIES = {"p6_found": p6_found, "p6_terms": p6_terms}
SQL = {
    "p6_found": _PAIRS + "SELECT table_name, go_term_id FROM r WHERE n_pairs * 100 >= 3 * all_pairs",
    "p6_terms": _PAIRS + "SELECT table_name, go_term_id, n_rows, n_pairs, round(n_pairs / all_pairs, 9) share, n_scored, "
    "s AS score_micros, score_min, score_max FROM r",
}
