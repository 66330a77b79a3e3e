"""Queries of label transfer, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinvote.functions.vectors import doubles, norm
from kinvote.operators import enrich, knn, lineage, score, votes
from kinvote.operators.pca import fit_embedding_pca, project
from kinvote.operators.transfer import LabelTransferConfig, nearest, predict
from kinvote.plans import fixtures
from kinvote.sources.tables import table

K = 5
QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df, *columns):
    """Doubles to six decimals, NaN as null."""
    return df.withColumns({c: F.round(F.when(~F.isnan(c), F.col(c)), 6) for c in columns})


def rounded_distance(df):
    """``rounded`` of the distance by arithmetic, as ``round`` in DuckDB has it; decimals cost several times as much over all pairs."""
    d = F.col("distance")
    return df.withColumn("distance", F.when(F.abs(d) < 1e9, F.floor(d * 1e6 + 0.5) / 1e6).otherwise(F.round(F.when(~F.isnan(d), d), 6)))


# ---- SQL parts ----

_FINE = "len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: isfinite(x)))"
_SIDES = f"""
q AS (SELECT query_pos, protein_accession, embedding::DOUBLE[] v FROM queries WHERE {_FINE}),
r AS (SELECT ref_pos, ref_accession, embedding::DOUBLE[] v FROM refs WHERE {_FINE}),
a AS (SELECT ref_accession, ann_pos, go_term_id, min(qualifier) qualifier, min(evidence_code) evidence_code FROM annotations
      WHERE ref_accession IS NOT NULL AND go_term_id IS NOT NULL GROUP BY 1, 2, 3),
ra AS (SELECT DISTINCT ref_accession, aspect FROM a JOIN terms USING (go_term_id) WHERE aspect IN ('F', 'P', 'C'))"""
_COSINE = "round(1 - list_dot_product(q.v, r.v) / ((sqrt(list_dot_product(q.v, q.v)) + 1e-9) * (sqrt(list_dot_product(r.v, r.v)) + 1e-9)), 12)"
_L2 = "round(greatest(0, list_dot_product(q.v, q.v) + list_dot_product(r.v, r.v) - 2 * list_dot_product(q.v, r.v)), 12)"


def _ranked(distance: str = _COSINE, k: int = K, where: str = "", banks: bool = False) -> str:
    """CTEs up to ``n``, the neighbours."""
    more = "JOIN ra USING (ref_accession)" if banks else ""
    return f"""WITH RECURSIVE {_SIDES},
d AS (SELECT {"ra.aspect" if banks else "''"} aspect_key, query_pos, protein_accession, ref_pos, ref_accession, {distance} distance FROM q CROSS JOIN r {more}),
n AS (SELECT *, stddev_pop(distance) OVER (PARTITION BY query_pos) neighbor_distance_std FROM
      (SELECT *, row_number() OVER (PARTITION BY aspect_key, query_pos ORDER BY distance, ref_pos) k_position FROM d {where}) WHERE k_position <= {k})"""


_SHOWN = "SELECT aspect_key, query_pos, protein_accession, k_position, ref_pos, ref_accession, round(distance, 6) distance FROM n"
_ORD = "CASE {} WHEN 'F' THEN 1 WHEN 'P' THEN 2 WHEN 'C' THEN 3 ELSE 0 END"


def _voted(banks: bool = False) -> str:
    """CTEs up to ``g``, one row per query and term."""
    only = "WHERE coalesce(t.aspect, '') = n.aspect_key" if banks else ""
    order = f"ORDER BY distance, {_ORD.format('aspect_key')}, k_position, ann_pos, ref_pos"
    return (
        _ranked(banks=banks)
        + f""",
v AS (SELECT n.*, a.ann_pos, a.go_term_id, a.qualifier, a.evidence_code, t.go_id, coalesce(t.aspect, '') aspect FROM n JOIN a USING (ref_accession) LEFT JOIN terms t USING (go_term_id) {only}),
g AS (SELECT query_pos, protein_accession, go_term_id, go_id, aspect, count(*) vote_count, min(k_position) k_position, min(distance) min_distance, avg(distance) mean_distance,
             max(neighbor_distance_std) neighbor_distance_std, count(*) / {K}.0::DOUBLE neighbor_vote_fraction,
             first(ref_accession {order}) ref_protein_accession, coalesce(first(qualifier {order}), '') qualifier, coalesce(first(evidence_code {order}), '') evidence_code
      FROM v GROUP BY 1, 2, 3, 4, 5),
f AS (SELECT go_term_id, count(*) go_term_frequency FROM a GROUP BY 1),
e AS (SELECT ref_accession ref_protein_accession, count(*) ref_annotation_density FROM a GROUP BY 1),
x AS (SELECT DISTINCT protein_accession, ref_accession, regexp_extract(protein_accession, '(\\d+)', 1)::BIGINT qn, regexp_extract(ref_accession, '(\\d+)', 1)::BIGINT rn FROM n),
pf AS (SELECT protein_accession, ref_accession, (qn * 31 + rn * 17) % 100 / 100 identity_nw, 50 + qn % 200 length_query, 50 + rn % 200 length_ref, (qn + rn) % 12 taxonomic_distance,
              CASE WHEN (qn * rn) % 6 <> 0 THEN (qn + 2 * rn) % 9 END taxonomic_common_ancestors,
              ['same', 'ancestor', 'descendant', 'child', 'parent', 'close', 'distant', NULL][(qn + rn) % 8 + 1] taxonomic_relation FROM x WHERE (qn + rn) % 4 <> 0),
p AS (SELECT g.*, coalesce(go_term_frequency, 0) go_term_frequency, coalesce(ref_annotation_density, 0) ref_annotation_density, pf.* EXCLUDE (protein_accession, ref_accession)
      FROM g LEFT JOIN f USING (go_term_id) LEFT JOIN e USING (ref_protein_accession)
      LEFT JOIN pf ON pf.protein_accession = g.protein_accession AND pf.ref_accession = g.ref_protein_accession)"""
    )


_VECTORS = f""",
tv AS (SELECT 'GO:' || lpad(vec_id::VARCHAR, 7, '0') go_id, CASE WHEN vec_id % 13 = 12 THEN list_transform(embedding, lambda x: 0.0::DOUBLE) ELSE embedding::DOUBLE[] END v FROM embeddings WHERE vec_id % 11 <> 10),
u AS (SELECT go_id, list_transform(v, lambda x: x / s) AS unit FROM (SELECT go_id, v, sqrt(list_dot_product(v, v)) s FROM tv) WHERE s > 0),
nt AS (SELECT query_pos, t.aspect, go_id, min({_ORD.format("aspect_key")}) OVER (PARTITION BY query_pos, t.aspect) lo, {_ORD.format("aspect_key")} ord, unit
       FROM n JOIN a USING (ref_accession) JOIN terms t USING (go_term_id) JOIN u USING (go_id) WHERE t.aspect IN ('F', 'P', 'C') AND go_id <> ''),
ns AS (SELECT DISTINCT query_pos, aspect, go_id, unit FROM nt WHERE ord = lo),
cm AS (SELECT query_pos, aspect, i, avg(y) y FROM (SELECT query_pos, aspect, unnest(unit) y, generate_subscripts(unit, 1) i FROM ns) GROUP BY 1, 2, 3),
cl AS (SELECT query_pos, aspect, list(y ORDER BY i) c FROM cm GROUP BY 1, 2),
mx AS (SELECT p.query_pos, p.go_term_id, max(list_dot_product(o.unit, ns.unit)) maxcos FROM p JOIN u o ON o.go_id = p.go_id JOIN ns ON ns.query_pos = p.query_pos AND ns.aspect = p.aspect GROUP BY 1, 2),
tf AS (SELECT p.query_pos, p.go_term_id, list_dot_product(o.unit, cl.c) / sqrt(list_dot_product(cl.c, cl.c)) anc2vec_neighbor_cos, maxcos anc2vec_neighbor_maxcos, (o.unit IS NOT NULL)::INT::DOUBLE anc2vec_has_emb
       FROM p LEFT JOIN u o ON o.go_id = p.go_id LEFT JOIN cl ON cl.query_pos = p.query_pos AND cl.aspect = p.aspect LEFT JOIN mx ON mx.query_pos = p.query_pos AND mx.go_term_id = p.go_term_id)"""
_VOTERS = """,
tc AS (SELECT query_pos, a.go_term_id, count_if(coalesce(taxonomic_relation, '') = 'same') same, count_if(coalesce(taxonomic_relation, '') IN ('same', 'ancestor', 'descendant', 'child', 'parent', 'close')) close_n,
              avg(taxonomic_common_ancestors) tax_voters_mean_common_ancestors, count(*) voters FROM n LEFT JOIN pf USING (protein_accession, ref_accession) JOIN a USING (ref_accession) GROUP BY 1, 2),
tx AS (SELECT query_pos, go_term_id, same / greatest(voters, 1) tax_voters_same_frac, close_n / greatest(voters, 1) tax_voters_close_frac, tax_voters_mean_common_ancestors FROM tc)"""


def _case(tree: list, i: int = 0) -> str:
    node = tree[i]
    if node.feature is None:
        return f"{node.value!r}::DOUBLE"
    left, right = _case(tree, node.left), _case(tree, node.right)
    return f"CASE WHEN {node.feature} IS NULL THEN {left if node.default_left else right} WHEN {node.feature} <= {node.threshold!r} THEN {left} ELSE {right} END"


def _sum(scale: float) -> str:
    return "0.0::DOUBLE + " + " + ".join(f"({_case(t)})" for t in fixtures.ensemble(scale).trees)


_ROW = (
    "query_pos, protein_accession, go_term_id, go_id, aspect, ref_protein_accession, qualifier, evidence_code, vote_count, k_position, round(min_distance, 6) min_distance, "
    "round(mean_distance, 6) mean_distance, round(neighbor_distance_std, 6) neighbor_distance_std, round(neighbor_vote_fraction, 6) neighbor_vote_fraction, go_term_frequency, ref_annotation_density"
)
_ROW_COLUMNS = ["query_pos", "protein_accession", "go_term_id", "go_id", "aspect", "ref_protein_accession", "qualifier", "evidence_code", "vote_count", "k_position", "min_distance", "mean_distance", "neighbor_distance_std", "neighbor_vote_fraction", "go_term_frequency", "ref_annotation_density"]
_ROW_DOUBLES = ("min_distance", "mean_distance", "neighbor_distance_std", "neighbor_vote_fraction")
_PAIR = ["identity_nw", "length_query", "length_ref", "taxonomic_distance", "taxonomic_common_ancestors", "taxonomic_relation"]

BLOCK = LabelTransferConfig(k=K, strategy="block", compute_v6_features=False)
SEPARATE = LabelTransferConfig(k=K, strategy="block", compute_v6_features=False, aspect_separated=True)


def _knn(spark, at, **options):
    q, r, _, _ = fixtures.inputs(spark, at)
    return rounded_distance(knn.knn_join(q, r, **{"k": K, "strategy": "block", "dim": fixtures.DIM} | options))


# ---- neighbours ----


@query(f"WITH {_SIDES} SELECT query_pos, ref_pos, round({_COSINE}, 6) distance FROM q, r")
def distance_matrix_cosine(spark, at):
    q, r, _, _ = fixtures.inputs(spark, at)
    return rounded_distance(knn.distance_matrix(q, r, "cosine", fixtures.DIM))


@query(f"WITH {_SIDES} SELECT query_pos, ref_pos, round({_L2}, 6) distance FROM q, r")
def distance_matrix_l2(spark, at):
    q, r, _, _ = fixtures.inputs(spark, at)
    return rounded_distance(knn.distance_matrix(q, r, "l2", fixtures.DIM))


@query(_ranked() + _SHOWN)
def knn_cosine(spark, at):
    return _knn(spark, at, strategy="auto")


@query(_ranked() + _SHOWN)
def knn_block(spark, at):
    return _knn(spark, at)


@query(_ranked() + _SHOWN)
def knn_jvm(spark, at):
    return _knn(spark, at, strategy="jvm")


@query(_ranked(_L2) + _SHOWN)
def knn_l2(spark, at):
    return _knn(spark, at, metric="l2")


@query(
    _ranked("round(1 - list_dot_product(q.v, list_transform(r.v, lambda x: x / sqrt(list_dot_product(r.v, r.v)))) / (sqrt(list_dot_product(q.v, q.v)) + 1e-9), 12)").replace("FROM q CROSS JOIN r", "FROM q CROSS JOIN (SELECT * FROM r WHERE list_dot_product(v, v) > 0) r")
    + _SHOWN
)
def knn_pre_normalized(spark, at):
    q, r, _, _ = fixtures.inputs(spark, at)
    unit = r.withColumn("v", doubles("embedding")).withColumn("s", norm("v")).where("s > 0").withColumn("embedding", F.transform("v", lambda x: F.try_divide(x, "s"))).drop("v", "s")
    return rounded(knn.knn_join(q, unit, K, strategy="block", pre_normalized=True, dim=fixtures.DIM), "distance")


@query(_ranked(where="WHERE distance <= 0.06") + _SHOWN)
def knn_threshold(spark, at):
    return _knn(spark, at, distance_threshold=0.06)


@query(_ranked(k=1_000_000_000) + _SHOWN)
def knn_k_exceeds_refs(spark, at):
    return _knn(spark, at, k=1_000_000_000)


@query(
    _ranked().replace("n AS (", "dd AS (SELECT DISTINCT ON (query_pos, ref_accession) * FROM d ORDER BY query_pos, ref_accession, distance, ref_pos),\nn AS (").replace("FROM d )", "FROM dd )")
    + _SHOWN
)
def knn_dedupe_accession(spark, at):
    return _knn(spark, at, dedupe=True)


@query(_ranked() + _SHOWN)
def knn_ivf_full_probe(spark, at):
    return _knn(spark, at, strategy="ivf", nlist=16, nprobe=16)


@query()
def knn_ivf(spark, at):
    return _knn(spark, at, strategy="ivf", nlist=64, nprobe=8)


@query()
def knn_lsh(spark, at):
    return _knn(spark, at, strategy="lsh")


@query("SELECT * FROM (VALUES ('ivf', true), ('lsh', true)) v(strategy, enough)")
def knn_recall(spark, at):
    """Whether the approximate strategies find at least 95 % of the exact neighbours of all queries."""
    true = knn.written(_knn(spark, at).select("query_pos", "ref_pos"))
    found = [_knn(spark, at, strategy=s, **o).select(F.lit(s).alias("strategy"), "query_pos", "ref_pos") for s, o in (("ivf", {"nlist": 64}), ("lsh", {}))]
    both = found[0].unionByName(found[1]).join(true, ["query_pos", "ref_pos"]).groupBy("strategy").agg(F.count(F.lit(1)).alias("n"))
    return both.join(F.broadcast(true.agg(F.count(F.lit(1)).alias("all")))).select("strategy", (F.col("n") >= 0.95 * F.col("all")).alias("enough"))


@query(_ranked(banks=True) + _SHOWN)
def knn_by_aspect(spark, at):
    return rounded(nearest(*fixtures.inputs(spark, at), SEPARATE), "distance").drop("neighbor_distance_std")


@query(f"WITH {_SIDES} SELECT ref_pos, aspect FROM refs JOIN ra USING (ref_accession)")
def refs_by_aspect(spark, at):
    _, r, a, t = fixtures.inputs(spark, at)
    return knn.refs_by_aspect(r, a, t)


# ---- votes ----


@query(_ranked() + "SELECT aspect_key, ref_accession, ann_pos, go_term_id, qualifier, evidence_code FROM a JOIN (SELECT DISTINCT aspect_key, ref_accession FROM n) USING (ref_accession)")
def neighbor_annotations(spark, at):
    q, r, a, t = fixtures.inputs(spark, at)
    return votes.neighbor_annotations(nearest(q, r, a, t, BLOCK), a)


@query(f"WITH {_SIDES} SELECT go_term_id, count(*) go_term_frequency FROM a GROUP BY 1")
def annotation_frequency(spark, at):
    return votes.annotation_frequency(fixtures.inputs(spark, at)[2])


@query(f"WITH {_SIDES} SELECT ref_accession, count(*) ref_annotation_density FROM a GROUP BY 1")
def annotation_density(spark, at):
    return votes.annotation_density(fixtures.inputs(spark, at)[2])


def _votes(spark, at, config):
    q, r, a, t = fixtures.inputs(spark, at)
    rows = votes.tally(votes.voters(nearest(q, r, a, t, config), a, t, config.aspect_separated), config.k)
    return rounded(rows, *_ROW_DOUBLES).select(*_ROW_COLUMNS[:-2])


_VOTE_ROW = _ROW.replace(", go_term_frequency, ref_annotation_density", "")


@query(_voted() + f"SELECT {_VOTE_ROW} FROM g")
def votes_unified(spark, at):
    return _votes(spark, at, BLOCK)


@query(_voted(True) + f"SELECT {_VOTE_ROW} FROM g")
def votes_by_aspect(spark, at):
    return _votes(spark, at, SEPARATE)


@query(_voted() + f"SELECT {_ROW} FROM p")
def predict_rows(spark, at):
    return rounded(predict(*fixtures.inputs(spark, at), BLOCK), *_ROW_DOUBLES).select(*_ROW_COLUMNS)


@query(_voted(True) + f"SELECT {_ROW} FROM p")
def predict_rows_by_aspect(spark, at):
    return rounded(predict(*fixtures.inputs(spark, at), SEPARATE), *_ROW_DOUBLES).select(*_ROW_COLUMNS)


def _pairs(spark, at, config):
    """Pair features of all neighbours."""
    return knn.written(fixtures.pair_features(nearest(*fixtures.inputs(spark, at), config)))


@query(_voted() + f"SELECT query_pos, go_term_id, ref_protein_accession, {', '.join(c if c == 'taxonomic_relation' else f'{c}::DOUBLE {c}' for c in _PAIR)} FROM p")
def predict_pair_features(spark, at):
    return predict(*fixtures.inputs(spark, at), BLOCK, pair_features=_pairs(spark, at, BLOCK)).select("query_pos", "go_term_id", "ref_protein_accession", *_PAIR)


@query(_voted() + "SELECT go_term_id FROM g UNION SELECT go_term_id FROM n JOIN a USING (ref_accession)")
def terms_in_play(spark, at):
    q, r, a, t = fixtures.inputs(spark, at)
    rows, said = predict(q, r, a, t, BLOCK, return_diagnostics=True)
    return enrich.terms_in_play(rows, said.neighbor_annotations)


# ---- features ----


@query(
    _ranked() + _VECTORS.split("u AS (")[0].rstrip(",\n ") + " SELECT i.go_id, (tv.v IS NOT NULL) AS found, round(list_sum(coalesce(tv.v, [0.0])), 6) total, coalesce(len(tv.v), 64) dim FROM (SELECT DISTINCT go_id FROM terms WHERE go_id IS NOT NULL) i LEFT JOIN tv USING (go_id)"
)
def term_vector_batch(spark, at):
    rows = enrich.term_vector_batch(table(spark, at, "terms"), fixtures.term_vectors(spark, at), fixtures.DIM)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    return rows.select("go_id", "found", F.round(total, 6).alias("total"), F.size("embedding").cast("long").alias("dim"))


def _term_features(spark, at, config):
    q, r, a, t = fixtures.inputs(spark, at)
    near = nearest(q, r, a, t, config)
    rows = votes.tally(votes.voters(near, a, t, config.aspect_separated), config.k)
    out = enrich.with_term_features(rows, near, a, t, fixtures.term_vectors(spark, at))
    names = ("anc2vec_neighbor_cos", "anc2vec_neighbor_maxcos", "anc2vec_has_emb")
    return rounded(out, *names).select("query_pos", "go_term_id", *names)


_TERM_ROW = "SELECT query_pos, go_term_id, round(anc2vec_neighbor_cos, 6) anc2vec_neighbor_cos, round(anc2vec_neighbor_maxcos, 6) anc2vec_neighbor_maxcos, anc2vec_has_emb FROM tf"


@query(_voted() + _VECTORS + _TERM_ROW)
def neighbor_term_features(spark, at):
    return _term_features(spark, at, BLOCK)


@query(_voted(True) + _VECTORS + _TERM_ROW)
def neighbor_term_features_by_aspect(spark, at):
    return _term_features(spark, at, SEPARATE)


def _taxonomy(spark, at, config):
    q, r, a, t = fixtures.inputs(spark, at)
    near = nearest(q, r, a, t, config)
    rows = votes.tally(votes.voters(near, a, t, config.aspect_separated), config.k)
    out = enrich.with_taxonomy_voters(rows, near, a, fixtures.pair_features(near))
    names = ("tax_voters_same_frac", "tax_voters_close_frac", "tax_voters_mean_common_ancestors")
    return rounded(out, *names).select("query_pos", "go_term_id", *names)


_TAX_ROW = "SELECT query_pos, go_term_id, round(tax_voters_same_frac, 6) tax_voters_same_frac, round(tax_voters_close_frac, 6) tax_voters_close_frac, round(tax_voters_mean_common_ancestors, 6) tax_voters_mean_common_ancestors FROM g JOIN tx USING (query_pos, go_term_id)"


@query(_voted() + _VOTERS + _TAX_ROW)
def tax_voters(spark, at):
    return _taxonomy(spark, at, BLOCK)


@query(_voted(True) + _VOTERS + _TAX_ROW)
def tax_voters_by_aspect(spark, at):
    return _taxonomy(spark, at, SEPARATE)


_PCA = ", ".join(f"round((v[{i + 1}] - 0.01) + 0.5 * (v[{i + 17}] - 0.01), 6) emb_pca_query_{i}" for i in range(16))


@query(f"WITH {_SIDES} SELECT query_pos, {_PCA} FROM q")
def pca_project_fixed(spark, at):
    rows = project(table(spark, at, "queries"), fixtures.pca_fixed())
    return rows.select("query_pos", *[F.round(F.col("projection")[i], 6).alias(f"emb_pca_query_{i}") for i in range(16)])


@query()
def pca_fit_project(spark, at):
    state = fit_embedding_pca(table(spark, at, "refs"), dim=fixtures.DIM)
    rows = project(table(spark, at, "queries"), state)
    return rows.select("query_pos", *[F.round(F.col("projection")[i], 6).alias(f"emb_pca_query_{i}") for i in range(16)])


@query("SELECT i::INT AS component, true centred, true uncorrelated, true ordered FROM range(16) t(i)")
def pca_fit_check(spark, at):
    """Whether the fitted references have mean 0 on every component, no covariance with another, and no more variance than on the one before."""
    refs = table(spark, at, "refs")
    state = fit_embedding_pca(refs, dim=fixtures.DIM)
    n = len(state.components)
    said = project(refs, state).select(*[F.col("projection")[i].alias(f"c{i}") for i in range(n)])
    one = said.agg(*[F.avg(f"c{i}").alias(f"m{i}") for i in range(n)], *[F.covar_pop(f"c{i}", f"c{j}").alias(f"v{min(i, j)}_{max(i, j)}") for i in range(n) for j in range(i, n)])
    small = lambda x: F.abs(x) <= 1e-9 * F.col("v0_0")
    every = lambda conditions: F.array_min(F.array(F.lit(True), *conditions))
    rows = [
        F.struct(
            F.lit(i).alias("component"), (F.abs(F.col(f"m{i}")) <= 1e-9 * F.sqrt("v0_0")).alias("centred"),
            every([small(F.col(f"v{min(i, j)}_{max(i, j)}")) for j in range(n) if j != i]).alias("uncorrelated"),
            every([F.col(f"v{i}_{i}") <= F.col(f"v{i - 1}_{i - 1}")] if i else []).alias("ordered"),
        )
        for i in range(n)
    ]
    return one.select(F.inline(F.array(*rows)))


# ---- lineage ----

_LINKS = r"""
l AS (SELECT DISTINCT 'GO:' || lpad(regexp_extract(go_id, '(\d+)', 1), greatest(7, len(regexp_extract(go_id, '(\d+)', 1)))::INT, '0') c, 'GO:' || lpad(regexp_extract(parent_id, '(\d+)', 1), greatest(7, len(regexp_extract(parent_id, '(\d+)', 1)))::INT, '0') p
      FROM term_parents WHERE regexp_matches(go_id, '\d') AND regexp_matches(parent_id, '\d'))"""
_CLOSURE = f"""{_LINKS},
z AS (SELECT c go_id, c ancestor FROM l UNION SELECT z.go_id, l.p FROM z JOIN l ON z.ancestor = l.c)"""


@query(f"WITH RECURSIVE {_CLOSURE} SELECT go_id, ancestor FROM z")
def lineage_closure(spark, at):
    parents = fixtures.parents(spark, at)
    return lineage.ancestor_closure(parents, parents)


_LINEAGE = """,
ci AS (SELECT DISTINCT protein_accession, go_id FROM g WHERE go_id <> ''),
kn AS (SELECT DISTINCT upper(regexp_extract(protein_accession, '[A-Za-z][0-9]{8}')) protein_accession, go_id k FROM training_rows WHERE label = 1 AND go_id <> '' AND regexp_matches(protein_accession, '[A-Za-z][0-9]{8}')),
up AS (SELECT ci.protein_accession, ci.go_id, count(*) n FROM ci JOIN kn USING (protein_accession) JOIN z ON z.go_id = kn.k AND z.ancestor = ci.go_id WHERE kn.k <> ci.go_id GROUP BY 1, 2),
dn AS (SELECT ci.protein_accession, ci.go_id, count(*) n FROM ci JOIN kn USING (protein_accession) JOIN z ON z.go_id = ci.go_id AND z.ancestor = kn.k WHERE kn.k <> ci.go_id GROUP BY 1, 2)
SELECT g.query_pos, g.go_term_id, (coalesce(up.n, 0) > 0)::INT::DOUBLE lineage_is_ancestor_of_known, (coalesce(dn.n, 0) > 0)::INT::DOUBLE lineage_is_descendant_of_known,
       coalesce(up.n, 0)::DOUBLE lineage_ancestor_of_count, coalesce(dn.n, 0)::DOUBLE lineage_descendant_of_count
FROM g LEFT JOIN up USING (protein_accession, go_id) LEFT JOIN dn USING (protein_accession, go_id)"""


@query(_voted() + "," + _CLOSURE + _LINEAGE)
def lineage_features(spark, at):
    rows = predict(*fixtures.inputs(spark, at), BLOCK).select("query_pos", "go_term_id", "protein_accession", "go_id")
    out = lineage.lineage_features(knn.written(rows), fixtures.parents(spark, at), fixtures.known(spark, at))
    return out.select("query_pos", "go_term_id", *lineage.LINEAGE_FEATURE_KEYS)


# ---- model inputs and scores ----

_CODED = """
b AS (SELECT prediction_id, min(qualifier) qualifier, min(evidence_code) evidence_code, min(aspect) aspect FROM predictions WHERE prediction_id IS NOT NULL GROUP BY 1)"""


def _categories(spark, at):
    """One row per prediction with its categories."""
    return table(spark, at, "predictions").where("prediction_id is not null").groupBy("prediction_id").agg(F.min("qualifier").alias("qualifier"), F.min("evidence_code").alias("evidence_code"), F.min("aspect").alias("aspect"))


def _first_codes(empty: str) -> str:
    parts = []
    for c in ("qualifier", "evidence_code", "aspect"):
        value = f"nullif({c}, '')" if empty else c
        parts.append(f"f_{c} AS (SELECT v, (row_number() OVER (ORDER BY first, v) - 1)::INT code FROM (SELECT {value} v, min(prediction_id) first FROM b GROUP BY 1) WHERE v IS NOT NULL)")
    joins = " ".join(f"LEFT JOIN f_{c} ON f_{c}.v = b.{c}" for c in ("qualifier", "evidence_code", "aspect"))
    return f"WITH {_CODED}, {', '.join(parts)} SELECT prediction_id, coalesce(f_qualifier.code, -1) qualifier, coalesce(f_evidence_code.code, -1) evidence_code, coalesce(f_aspect.code, -1) aspect FROM b {joins}"


@query(_first_codes("missing"))
def encode_factorize(spark, at):
    return score.encode_factorize(_categories(spark, at), ["qualifier", "evidence_code", "aspect"], "prediction_id")


_VOCABULARY = {"qualifier": ["enables", "involved_in", "located_in"], "evidence_code": ["IEA", "IBA", "IDA"], "aspect": ["F", "P", "C", ""]}


@query(
    f"WITH {_CODED} SELECT prediction_id, "
    + ", ".join(f"coalesce(list_position([{', '.join(repr(w) for w in words)}], {c}), 0)::INT - 1 {c}" for c, words in _VOCABULARY.items())
    + " FROM b"
)
def encode_vocabulary(spark, at):
    return score.encode_vocabulary(_categories(spark, at), _VOCABULARY)


@query(
    _first_codes("missing").replace("SELECT prediction_id, coalesce(f_q", "SELECT prediction_id, s.vote_count::DOUBLE vote_count, s.min_distance, s.label, coalesce(f_q").replace(
        "FROM b LEFT", "FROM b JOIN (SELECT prediction_id, max(vote_count) vote_count, max(min_distance) min_distance, (max(vote_count) > 2)::INT AS label FROM predictions GROUP BY 1) s USING (prediction_id) LEFT"
    )
)
def prepare_dataset(spark, at):
    from kinvote.schema import FeatureSchema

    numbers = table(spark, at, "predictions").groupBy("prediction_id").agg(F.max("vote_count").cast("string").alias("vote_count"), F.max("min_distance").alias("min_distance"), (F.max("vote_count") > 2).cast("long").alias("label"))
    schema = FeatureSchema(("vote_count", "min_distance", "k_context"), ("qualifier", "evidence_code", "aspect", "plm_id"))
    return score.prepare_dataset(_categories(spark, at).join(numbers, "prediction_id"), "prediction_id", schema)


_MADE = ["prediction_set_id", "distance", "neighbor_min_distance", "neighbor_mean_distance", "anc2vec_query_known_cos", "anc2vec_query_known_maxcos", "anc2vec_query_known_count"]
_OTHER = ", ".join(f"CASE WHEN p.identity_nw IS NOT NULL THEN {x} END::DOUBLE {c}" for c, x in fixtures.MORE_PAIR_COLUMNS.items())


@query(
    _voted()
    + f"""SELECT query_pos, go_term_id, {", ".join(f"{c}::DOUBLE {c}" for c in _PAIR[:-1])}, taxonomic_relation, {_OTHER}, 'set-1' prediction_set_id, round(min_distance, 6) distance,
       round(min_distance, 6) neighbor_min_distance, round(mean_distance, 6) neighbor_mean_distance, NULL::DOUBLE anc2vec_query_known_cos, NULL::DOUBLE anc2vec_query_known_maxcos, 0.0::DOUBLE anc2vec_query_known_count
FROM (SELECT *, regexp_extract(protein_accession, '(\d+)', 1)::BIGINT q, regexp_extract(ref_protein_accession, '(\d+)', 1)::BIGINT r FROM p) p"""
)
def predict_all_pair_columns(spark, at):
    config = LabelTransferConfig(k=K, strategy="block", prediction_set_id="set-1")
    pairs = knn.written(fixtures.all_pair_features(nearest(*fixtures.inputs(spark, at), config)))
    out = predict(*fixtures.inputs(spark, at), config, pair_features=pairs)
    return rounded(out, *_MADE[1:]).select("query_pos", "go_term_id", *_PAIR, *fixtures.MORE_PAIR_COLUMNS, *_MADE)


def _model_rows(spark, at):
    """Categories and numbers of every prediction, without a label."""
    numbers = table(spark, at, "predictions").groupBy("prediction_id").agg(F.max("vote_count").alias("vote_count"), F.max("neighbor_vote_fraction").alias("neighbor_vote_fraction"))
    return knn.written(_categories(spark, at).join(numbers, "prediction_id"))


def _coded_score(coded: str) -> str:
    """SQL of ``fixtures.coded_ensemble`` over a query with codes."""
    fraction = "CASE WHEN isnan(neighbor_vote_fraction) THEN NULL ELSE neighbor_vote_fraction END"
    return f"""SELECT prediction_id, round((CASE WHEN aspect <= 0.5 THEN CASE WHEN vote_count <= 2.5 THEN 0.2 ELSE 0.3 END ELSE 0.1 END
           + CASE WHEN evidence_code IN (0, 2) THEN 0.4 WHEN coalesce({fraction} <= 0.3, true) THEN 0.05 ELSE 0.25 END)::DOUBLE, 6) reranker_score
    FROM ({coded}) JOIN (SELECT prediction_id, max(vote_count) vote_count, max(neighbor_vote_fraction) neighbor_vote_fraction FROM predictions GROUP BY 1) USING (prediction_id)"""


@query(_coded_score(f"WITH {_CODED} SELECT prediction_id, " + ", ".join(f"coalesce(list_position([{', '.join(repr(w) for w in _VOCABULARY[c])}], {c}), 0)::INT - 1 {c}" for c in ("evidence_code", "aspect")) + " FROM b"))
def predict_scores_vocabulary(spark, at):
    out = score.predict_scores(_model_rows(spark, at), fixtures.coded_ensemble(), "prediction_id", _VOCABULARY)
    return rounded(out, "reranker_score").select("prediction_id", "reranker_score")


@query(_coded_score(_first_codes("")))
def predict_scores_first_codes(spark, at):
    out = score.predict_scores(_model_rows(spark, at), fixtures.coded_ensemble(), "prediction_id")
    return rounded(out, "reranker_score").select("prediction_id", "reranker_score")


def _scored(spark, at, **models):
    out = predict(*fixtures.inputs(spark, at), BLOCK, pair_features=_pairs(spark, at, BLOCK), **models)
    return rounded(out, "reranker_score").select("query_pos", "go_term_id", "reranker_score")


@query(_voted() + f"SELECT query_pos, go_term_id, round({_sum(1.0)}, 6) reranker_score FROM p")
def score_single(spark, at):
    return _scored(spark, at, model=fixtures.ensemble())


@query(_voted() + f"SELECT query_pos, go_term_id, round(1 / (1 + exp(-({_sum(8.0)}))), 6) reranker_score FROM p")
def score_sigmoid(spark, at):
    return _scored(spark, at, model=fixtures.ensemble(8.0))


@query(_voted() + f"SELECT query_pos, go_term_id, round(CASE aspect WHEN 'F' THEN {_sum(1.0)} WHEN 'P' THEN 1 / (1 + exp(-({_sum(8.0)}))) END, 6) reranker_score FROM p")
def score_by_aspect(spark, at):
    return _scored(spark, at, models_by_aspect={"F": fixtures.ensemble(), "P": fixtures.ensemble(8.0)})


_FEATURES = ["anc2vec_neighbor_cos", "anc2vec_neighbor_maxcos", "anc2vec_has_emb", "tax_voters_same_frac", "tax_voters_close_frac", "tax_voters_mean_common_ancestors"]


@query(
    _voted() + _VECTORS + _VOTERS + f" SELECT {_ROW}, {', '.join(f'{c}::DOUBLE {c}' for c in _PAIR[:-1])}, taxonomic_relation, {', '.join(f'round({c}, 6) {c}' for c in _FEATURES)}, {_PCA.split(', round')[0]}, round({_sum(1.0)}, 6) reranker_score FROM p JOIN tf USING (query_pos, go_term_id) JOIN tx USING (query_pos, go_term_id) JOIN (SELECT query_pos, v FROM q) USING (query_pos)"
)
def predict_full(spark, at):
    config = LabelTransferConfig(k=K, strategy="block", compute_taxonomy=True)
    out = predict(*fixtures.inputs(spark, at), config, pair_features=_pairs(spark, at, config), term_vectors=fixtures.term_vectors(spark, at), pca_state=fixtures.pca_fixed(), model=fixtures.ensemble())
    names = [*_FEATURES, "emb_pca_query_0", "reranker_score"]
    return rounded(out, *_ROW_DOUBLES, *names).select(*_ROW_COLUMNS, *_PAIR, *names)
