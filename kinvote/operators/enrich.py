"""Features of voted rows from term vectors, taxonomy voters and the query's PCA."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinvote.functions.vectors import dot, doubles, norm
from kinvote.operators.pca import project
from kinvote.operators.votes import aspect_order, bounded, one_pair
from kinvote.schema import ASPECT_CODES, CLOSE_RELATIONS, EMBEDDING_PCA_DIM, PCA_KEYS

NAN = float("nan")


def _one_vector(term_vectors: DataFrame) -> DataFrame:
    """(go_id, v): the least vector of every id."""
    return term_vectors.dropna(subset=["go_id", "embedding"]).select("go_id", doubles("embedding").alias("v")).groupBy("go_id").agg(F.min("v").alias("v"))


def unit_vectors(term_vectors: DataFrame) -> DataFrame:
    """(go_id, unit) of the terms whose vector is not zero; of a repeated id the least vector counts."""
    return _one_vector(term_vectors).withColumn("n", norm("v")).where("n > 0").select("go_id", F.transform("v", lambda x: F.try_divide(x, "n")).alias("unit"))


def term_vector_batch(terms: DataFrame, term_vectors: DataFrame, dim: int, zero_if_missing: bool = True) -> DataFrame:
    """(go_id, embedding, found) for every distinct go_id of ``terms``: zeros, or NaN, where there is no vector; of a repeated id the least vector counts."""
    fill = F.array_repeat(F.lit(0.0 if zero_if_missing else NAN), dim)
    ids = terms.select("go_id").dropna().distinct()
    rows = ids.join(_one_vector(term_vectors), "go_id", "left")
    return rows.select("go_id", F.coalesce("v", fill).alias("embedding"), F.col("v").isNotNull().alias("found"))


def terms_in_play(rows: DataFrame, neighbor_annotations: DataFrame) -> DataFrame:
    """Distinct go_term_id of candidates and of all neighbours' annotations."""
    return rows.select("go_term_id").unionByName(neighbor_annotations.select("go_term_id")).distinct()


def neighbor_terms(neighbors: DataFrame, annotations: DataFrame, terms: DataFrame, units: DataFrame) -> DataFrame:
    """(query_pos, aspect, go_id, unit): the distinct neighbour terms that form each centroid.

    All lists are scanned for all aspects; of a query and aspect the first list
    (in aspect order) that has a vector is taken.
    """
    known = terms.where(F.col("aspect").isin(*ASPECT_CODES) & (F.col("go_id") != "")).select("go_term_id", "go_id", "aspect")
    rows = (
        neighbors.select("query_pos", "aspect_key", "ref_accession").join(annotations.select("ref_accession", "go_term_id"), "ref_accession")
        .join(bounded(known), "go_term_id").select("query_pos", aspect_order("aspect_key").alias("list"), "aspect", "go_id").distinct().join(units, "go_id")
    )
    first = rows.groupBy("query_pos", "aspect").agg(F.min("list").alias("list"))
    return rows.join(first, ["query_pos", "aspect", "list"]).select("query_pos", "aspect", "go_id", "unit")


def centroids(neighbor_terms: DataFrame) -> DataFrame:
    """(query_pos, aspect, centroid) as a unit vector, null if the mean is zero.

    The mean is taken per dimension, so no query's vectors are gathered.
    """
    means = neighbor_terms.select("query_pos", "aspect", F.posexplode("unit").alias("i", "x")).groupBy("query_pos", "aspect", "i").agg(F.avg("x").alias("x"))
    whole = means.groupBy("query_pos", "aspect").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("c")).select("query_pos", "aspect", F.transform("c", lambda e: e["x"]).alias("c"))
    return whole.withColumn("n", norm("c")).select("query_pos", "aspect", F.when(F.col("n") > 0, F.transform("c", lambda x: F.try_divide(x, "n"))).alias("centroid"))


def with_term_features(rows: DataFrame, neighbors: DataFrame, annotations: DataFrame, terms: DataFrame, term_vectors: DataFrame | None) -> DataFrame:
    """Add the cosine to the neighbours' centroid, the largest cosine to one of their terms, and the flags.

    Without term vectors no candidate has one. The query-known columns are
    constants at prediction time.
    """
    constant = {"anc2vec_query_known_cos": NAN, "anc2vec_query_known_maxcos": NAN, "anc2vec_query_known_count": 0.0}
    if term_vectors is None:
        out = rows.withColumns({"anc2vec_neighbor_cos": F.lit(NAN), "anc2vec_neighbor_maxcos": F.lit(NAN), "anc2vec_has_emb": F.lit(0.0)})
    else:
        units = unit_vectors(term_vectors)
        near = neighbor_terms(neighbors, annotations, terms, units)
        mine = rows.join(units, "go_id", "left")
        candidates = mine.where("unit is not null").select("query_pos", "go_term_id", "aspect", F.col("unit").alias("own"))
        maxima = candidates.join(near, ["query_pos", "aspect"]).groupBy("query_pos", "go_term_id").agg(F.max(dot("own", "unit")).alias("anc2vec_neighbor_maxcos"))
        out = (
            mine.join(centroids(near), ["query_pos", "aspect"], "left")
            .join(maxima, ["query_pos", "go_term_id"], "left")
            .withColumn("anc2vec_neighbor_cos", F.coalesce(F.when(F.col("unit").isNotNull() & F.col("centroid").isNotNull(), dot("unit", "centroid")), F.lit(NAN)))
            .withColumn("anc2vec_neighbor_maxcos", F.coalesce("anc2vec_neighbor_maxcos", F.lit(NAN)))
            .withColumn("anc2vec_has_emb", F.col("unit").isNotNull().cast("double"))
            .drop("unit", "centroid")
        )
    return out.withColumns({c: F.lit(v) for c, v in constant.items()})


def taxonomy_counters(neighbors: DataFrame, annotations: DataFrame, pair_features: DataFrame) -> DataFrame:
    """(query_pos, go_term_id, same, close, ca_sum, ca_n, voters) over all lists of a query.

    The lists are not filtered by aspect, so a reference in three lists counts three times.
    """
    ca = F.col("taxonomic_common_ancestors").cast("double")
    relation = F.coalesce("taxonomic_relation", F.lit(""))
    pairs = one_pair(pair_features, ["taxonomic_relation", "taxonomic_common_ancestors"])
    return (
        neighbors.join(pairs, ["protein_accession", "ref_accession"], "left")
        .join(annotations.select("ref_accession", "go_term_id"), "ref_accession")
        .groupBy("query_pos", "go_term_id")
        .agg(
            F.count_if(relation == "same").alias("same"), F.count_if(relation.isin(*CLOSE_RELATIONS)).alias("close"),
            F.coalesce(F.sum(ca), F.lit(0.0)).alias("ca_sum"), F.count(ca).alias("ca_n"), F.count(F.lit(1)).alias("voters"),
        )
    )


def with_taxonomy_voters(rows: DataFrame, neighbors: DataFrame, annotations: DataFrame, pair_features: DataFrame | None) -> DataFrame:
    """Add the shares of same and close voters and their mean common ancestors; NaN without pair features."""
    if pair_features is None:
        return rows.withColumns(dict.fromkeys(("tax_voters_same_frac", "tax_voters_close_frac", "tax_voters_mean_common_ancestors"), F.lit(NAN)))
    out = rows.join(taxonomy_counters(neighbors, annotations, pair_features), ["query_pos", "go_term_id"], "left")
    over = F.greatest(F.coalesce("voters", F.lit(1)), F.lit(1))
    return out.withColumns(
        {
            "tax_voters_same_frac": F.coalesce("same", F.lit(0)) / over,
            "tax_voters_close_frac": F.coalesce("close", F.lit(0)) / over,
            "tax_voters_mean_common_ancestors": F.coalesce(F.when(F.col("ca_n") > 0, F.col("ca_sum") / F.col("ca_n")), F.lit(NAN)),
        }
    ).drop("same", "close", "ca_sum", "ca_n", "voters")


def with_pca(rows: DataFrame, queries: DataFrame, state) -> DataFrame:
    """Add the query's coordinates in the PCA space; NaN without a state, and beyond its components."""
    if state is None:
        return rows.withColumns(dict.fromkeys(PCA_KEYS, F.lit(NAN)))
    there = min(EMBEDDING_PCA_DIM, len(state.components))
    points = project(queries, state).select("query_pos", *[F.col("projection")[i].alias(PCA_KEYS[i]) for i in range(there)])
    out = rows.join(points, "query_pos", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(NAN)) if i < there else F.lit(NAN) for i, c in enumerate(PCA_KEYS)})


def enrich_v6_features(
    rows: DataFrame, neighbors: DataFrame, annotations: DataFrame, terms: DataFrame, queries: DataFrame, *,
    term_vectors: DataFrame | None = None, pair_features: DataFrame | None = None, pca_state=None, compute_taxonomy: bool = False,
) -> DataFrame:
    """All of the above on voted rows; without ``compute_taxonomy`` the voters' columns are NaN."""
    out = with_term_features(rows, neighbors, annotations, terms, term_vectors)
    out = with_taxonomy_voters(out, neighbors, annotations, pair_features if compute_taxonomy else None)
    return with_pca(out, queries, pca_state)
