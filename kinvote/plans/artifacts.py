"""Queries that go through stored artifacts and through a stream, each with the SQL of its plain counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinvote import schema
from kinvote.operators.pca import project
from kinvote.operators.score import apply_reranker, to_lightgbm
from kinvote.plans import fixtures, transfer
from kinvote.sources import artifacts
from kinvote.sources.scratch import place
from kinvote.sources.tables import table
from kinvote.streaming.predict import predict_stream

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query(transfer.SQL["term_vector_batch"])
def term_vectors_from_file(spark, at):
    """Term vectors written as Parquet, read again and looked up in an index."""
    path = place(spark, "term-vectors")
    fixtures.term_vectors(spark, at).write.parquet(path)
    index = artifacts.TermVectorIndex(artifacts.read_term_vectors(spark, path))
    rows = index.batch(table(spark, at, "terms"))
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    return rows.select("go_id", "found", F.round(total, 6).alias("total"), F.size("embedding").cast("long").alias("dim"))


@query(transfer.SQL["pca_project_fixed"])
def pca_from_state(spark, at):
    """A saved state is loaded instead of fitted, whatever the vectors are."""
    directory = place(spark, "pca")
    artifacts.save_pca_state(spark, fixtures.pca_fixed(), "fixed", directory)
    state = artifacts.load_or_fit_pca_state(spark, "fixed", table(spark, at, "refs"), directory)
    rows = project(table(spark, at, "queries"), state)
    return rows.select("query_pos", *[F.round(F.col("projection")[i], 6).alias(f"emb_pca_query_{i}") for i in range(schema.EMBEDDING_PCA_DIM)])


def _scored(spark, at, model):
    rows = transfer.predict(*fixtures.inputs(spark, at), transfer.BLOCK, pair_features=transfer._pairs(spark, at, transfer.BLOCK)).drop("reranker_score")
    return transfer.rounded(apply_reranker(rows, model), "reranker_score").select("query_pos", "go_term_id", "reranker_score")


@query(transfer.SQL["score_single"])
def score_model_from_json(spark, at):
    path = place(spark, "model", ".json")
    spark.createDataFrame([(fixtures.ensemble().to_string(),)], "text string").coalesce(1).write.text(path)
    return _scored(spark, at, artifacts.read_model(spark, path))


@query(transfer.SQL["score_single"])
def score_model_from_lightgbm(spark, at):
    path = place(spark, "model", ".txt")
    spark.createDataFrame([(to_lightgbm(fixtures.ensemble()),)], "text string").coalesce(1).write.text(path)
    return _scored(spark, at, artifacts.read_model(spark, path))


@query(transfer.SQL["score_single"])
def score_model_from_table(spark, at):
    """The ensemble as a table of nodes."""
    nodes = [(t, i, n.feature, n.threshold, n.left, n.right, n.default_left, n.value) for t, tree in enumerate(fixtures.ensemble().trees) for i, n in enumerate(tree)]
    path = place(spark, "model")
    spark.createDataFrame(nodes, "tree int, node int, feature string, threshold double, left int, right int, default_left boolean, value double").write.parquet(path)
    return _scored(spark, at, artifacts.read_model(spark, path))


@query(transfer.SQL["predict_rows"])
def predict_stream_rows(spark, at):
    """The queries arrive as a stream of files; every micro-batch is written under its number."""
    source, out, state = (place(spark, x) for x in ("stream-in", "stream-out", "stream-state"))
    table(spark, at, "queries").repartition(3, "query_pos").write.parquet(source)
    stream = spark.readStream.schema(table(spark, at, "queries").schema).option("maxFilesPerTrigger", 2).parquet(source)
    _, refs, annotations, terms = fixtures.inputs(spark, at)
    predict_stream(stream, refs, annotations, terms, lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/batch={n}"), state, transfer.BLOCK).awaitTermination()
    return transfer.rounded(spark.read.parquet(out), *transfer._ROW_DOUBLES).select(*transfer._ROW_COLUMNS)


@query("""SELECT * FROM (VALUES (false, false, false, 'annotation_meta,knn'), (true, false, false, 'alignment_nw,annotation_meta,knn,length'), (false, true, false, 'annotation_meta,knn,taxonomy_pair'),
    (false, false, true, 'anc2vec_neighbor,anc2vec_query,annotation_meta,emb_pca,go_context,knn,taxonomy_voters'),
    (true, true, true, 'alignment_nw,anc2vec_neighbor,anc2vec_query,annotation_meta,emb_pca,go_context,knn,length,taxonomy_pair,taxonomy_voters')) v(alignments, taxonomy, v6, families)""")
def feature_families(spark, at):
    """The feature families of some switches, in sorted order."""
    cases = [(False, False, False), (True, False, False), (False, True, False), (False, False, True), (True, True, True)]
    return spark.createDataFrame([(*x, ",".join(schema.infer_active_feature_families(*x))) for x in cases], "alignments boolean, taxonomy boolean, v6 boolean, families string")
