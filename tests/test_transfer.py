"""Label transfer against a plain row-by-row computation, and its parts."""

from __future__ import annotations

import math
import time

import numpy as np
import pyarrow as pa
import pytest
from kinvote.operators import enrich, lineage, score, votes
from kinvote.operators.knn import matrix_distance
from kinvote.operators.pca import PcaState, fit_embedding_pca, project
from kinvote.operators.transfer import LabelTransferConfig, predict
from kinvote.schema import LINEAGE_FEATURE_KEYS, PREDICTION_COLUMNS, FeatureSchema, infer_active_feature_families
from kinvote.sources import artifacts
from kinvote.streaming.predict import predict_stream
from pyspark.sql import functions as F

TERMS = [(1, "GO:0000001", "F"), (2, "GO:0000002", "P"), (3, "GO:0000003", "C"), (4, None, "F"), (5, "GO:0000005", None)]


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(5)
    q, r = rng.normal(size=(3, 6)).astype("f4"), rng.normal(size=(12, 6)).astype("f4")
    notes = [(f"R{i:02d}", p, int(rng.integers(1, 6)), ["enables", None, ""][i % 3], "IEA") for i in range(12) if i != 3 for p in range(1 + i % 3)]
    pairs = [(f"Q{a}", f"R{b:02d}", (a + b) / 20, ["same", "child", "distant", None][(a + b) % 4], None if b % 5 == 0 else a + b) for a in range(3) for b in range(12) if (a + b) % 3]
    make = spark.createDataFrame
    return {
        "q": make([(i, f"Q{i}", v.tolist()) for i, v in enumerate(q)], "query_pos long, protein_accession string, embedding array<float>").cache(),
        "r": make([(i, f"R{i:02d}", v.tolist()) for i, v in enumerate(r)], "ref_pos long, ref_accession string, embedding array<float>").cache(),
        "a": make(notes, "ref_accession string, ann_pos int, go_term_id long, qualifier string, evidence_code string").cache(),
        "t": make(TERMS, "go_term_id long, go_id string, aspect string").cache(),
        "p": make(pairs, "protein_accession string, ref_accession string, identity_nw double, taxonomic_relation string, taxonomic_common_ancestors int").cache(),
        "v": make([("GO:0000001", [1.0, 0.0]), ("GO:0000002", [3.0, 4.0]), ("GO:0000003", [0.0, 0.0]), ("GO:0000099", [1.0, 1.0])], "go_id string, embedding array<float>").cache(),
        "numpy": (q.astype("f8"), r.astype("f8"), notes, pairs),
    }


def brute(world, k, separate):
    """{(query, term): row} by walking the ranked lists one by one."""
    q, r, notes, _ = world["numpy"]
    aspect = {i: a or "" for i, _, a in TERMS}
    of = {}
    for n in notes:
        of.setdefault(n[0], []).append(n)
    d, out = matrix_distance(q, r, "cosine"), {}
    for i in range(len(q)):
        lists = {}
        for key in ("F", "P", "C") if separate else ("",):
            own = [j for j in range(len(r)) if not separate or any(aspect[n[2]] == key for n in of.get(f"R{j:02d}", []))]
            lists[key] = sorted((round(d[i, j], 12), j) for j in own)[:k]
        spread = np.std([x for own in lists.values() for x, _ in own])
        for key, own in lists.items():
            for rank, (x, j) in enumerate(own, 1):
                for n in of.get(f"R{j:02d}", []):
                    if separate and aspect[n[2]] != key:
                        continue
                    row = out.setdefault((i, n[2]), {"n": 0, "sum": 0.0, "min": x, "rank": rank, "donor": n[0], "qualifier": n[3] or "", "std": spread})
                    row["n"] += 1
                    row["sum"] += x
    return out


@pytest.mark.parametrize("separate", [False, True])
def test_votes(world, separate):
    rows, said = predict(world["q"], world["r"], world["a"], world["t"], LabelTransferConfig(k=4, aspect_separated=separate, prediction_set_id="s"), return_diagnostics=True)
    assert dict(rows.dtypes) == {c: t.simpleString() for c, t in PREDICTION_COLUMNS.items()}
    got, want = {(x["query_pos"], x["go_term_id"]): x for x in rows.collect()}, brute(world, 4, separate)
    assert set(got) == set(want)
    count = {}
    for n in world["numpy"][2]:
        count[n[2]] = count.get(n[2], 0) + 1
    for key, w in want.items():
        x = got[key]
        assert (x["vote_count"], x["k_position"], x["ref_protein_accession"], x["qualifier"], x["prediction_set_id"]) == (w["n"], w["rank"], w["donor"], w["qualifier"], "s")
        assert (x["min_distance"], x["mean_distance"], x["neighbor_distance_std"]) == pytest.approx((w["min"], w["sum"] / w["n"], w["std"]), abs=1e-9)
        assert x["neighbor_vote_fraction"] == w["n"] / 4 and x["go_term_frequency"] == count[key[1]]
    assert {x["aspect_key"] for x in said.neighbors.collect()} == ({"F", "P", "C"} if separate else {""})


def test_features_of_one_query(world):
    config = LabelTransferConfig(k=12, compute_taxonomy=True)
    rows = predict(world["q"], world["r"], world["a"], world["t"], config, pair_features=world["p"], term_vectors=world["v"], pca_state=PcaState([0.0] * 6, [[1.0] + [0.0] * 5])).collect()
    pairs = {(p[0], p[1]): p for p in world["numpy"][3]}
    for x in rows:
        own = [n for n in world["numpy"][2] if n[2] == x["go_term_id"]]
        found = [pairs.get((x["protein_accession"], n[0])) for n in own]
        same = sum(p is not None and p[3] == "same" for p in found)
        near = sum(p is not None and p[3] in ("same", "child") for p in found)
        shared = [p[4] for p in found if p is not None and p[4] is not None]
        assert x["tax_voters_same_frac"] == pytest.approx(same / len(own)) and x["tax_voters_close_frac"] == pytest.approx(near / len(own))
        assert x["tax_voters_mean_common_ancestors"] == pytest.approx(np.mean(shared)) if shared else math.isnan(x["tax_voters_mean_common_ancestors"])
        donor = pairs.get((x["protein_accession"], x["ref_protein_accession"]))
        assert x["identity_nw"] == (donor and donor[2]) and x["length_ref"] is None
        assert x["anc2vec_has_emb"] == float(x["go_id"] in ("GO:0000001", "GO:0000002"))
        assert x["anc2vec_neighbor_maxcos"] == pytest.approx(1) if x["anc2vec_has_emb"] else math.isnan(x["anc2vec_neighbor_maxcos"])
        assert x["anc2vec_query_known_count"] == 0 and math.isnan(x["anc2vec_query_known_cos"])
        assert x["emb_pca_query_0"] == pytest.approx(float(world["numpy"][0][x["query_pos"]][0])) and math.isnan(x["emb_pca_query_1"])


def test_empty_inputs_keep_the_columns(world):
    for q, r in ((world["q"].limit(0), world["r"]), (world["q"], world["r"].limit(0))):
        out = predict(q, r, world["a"], world["t"], pair_features=world["p"], term_vectors=world["v"])
        assert out.columns == list(PREDICTION_COLUMNS) and out.count() == 0
    with pytest.raises(ValueError, match="unique"):
        predict(world["q"].unionByName(world["q"]), world["r"], world["a"], world["t"])


def test_separated_centroid_comes_from_the_first_list_with_a_vector(spark):
    near = spark.createDataFrame([(1, "P", "A"), (1, "F", "B")], "query_pos long, aspect_key string, ref_accession string")
    notes = spark.createDataFrame([("A", 1), ("B", 2)], "ref_accession string, go_term_id long")
    terms = spark.createDataFrame([(1, "a", "P"), (2, "b", "P")], "go_term_id long, go_id string, aspect string")
    units = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "go_id string, unit array<double>")
    assert [(x["aspect"], x["go_id"]) for x in enrich.neighbor_terms(near, notes, terms, units).collect()] == [("P", "b")]


DAG = [("GO:2", "GO:1"), ("GO:3", "GO:1"), ("GO:4", "GO:2"), ("GO:5", "GO:3"), ("GO:5", "GO:2"), ("GO:8", "GO:9"), ("GO:9", "GO:8")]


def test_lineage(spark):
    cases = [
        ("a", "GO:2", ["GO:4"], 1, 0), ("b", "GO:4", ["GO:1"], 0, 1), ("c", "GO:5", ["GO:4"], 0, 0), ("d", "GO:4", ["GO:4"], 0, 0), ("e", "GO:1", ["GO:4", "GO:5"], 2, 0),
        ("f", "GO:5", ["GO:2"], 0, 1), ("g", "GO:77", ["GO:4"], 0, 0), ("h", "", ["GO:4"], 0, 0), (None, "GO:1", [], 0, 0), ("i", "GO:8", ["GO:9"], 1, 1), ("j", None, ["GO:1"], 0, 0),
    ]
    rows = spark.createDataFrame([(p, g) for p, g, *_ in cases], "protein_accession string, go_id string")
    known = spark.createDataFrame([(p, k) for p, _, ks, *_ in cases for k in ks * 2], "protein_accession string, go_id string")
    parents = spark.createDataFrame(DAG, "go_id string, parent_id string")
    got = {x["protein_accession"]: tuple(x[c] for c in LINEAGE_FEATURE_KEYS) for x in lineage.lineage_features(rows, parents, known).collect()}
    assert got == {p: (float(u > 0), float(d > 0), float(u), float(d)) for p, _, _, u, d in cases}


def test_pca_agrees_with_svd(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(200, 12)) * np.arange(1, 13)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "query_pos long, embedding array<double>")
    state = fit_embedding_pca(rows, 4)
    _, _, vh = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.abs((np.array(state.components) * vh[:4]).sum(1)) == pytest.approx(np.ones(4), abs=1e-6)
    assert all(max(c, key=abs) > 0 for c in state.components)
    got = np.array([r["projection"] for r in project(rows, state).orderBy("query_pos").collect()])
    assert got == pytest.approx((x - x.mean(0)) @ np.array(state.components).T)
    at = f"file://{tmp_path}"
    assert artifacts.load_pca_state(spark, "c", at) is None
    assert artifacts.load_or_fit_pca_state(spark, "c", rows.limit(0), at) is None
    artifacts.save_pca_state(spark, state, "c", at)
    assert artifacts.load_or_fit_pca_state(spark, "c", rows.limit(0), at) == state
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part.parquet").write_bytes(b"nothing")
    assert artifacts.load_pca_state(spark, "bad", at) is None
    with pytest.raises(ValueError, match="no usable"):
        fit_embedding_pca(rows.limit(0))


def test_public_names():
    from kinvote import api

    assert all(hasattr(api, name) for name in api.__all__)


def test_term_vector_archive(spark, tmp_path):
    np.savez(tmp_path / "v.npz", embeddings=np.eye(3, dtype="f4"), go_ids=np.array(["a", "b", "c"], dtype=object), ontology_release="r1")
    rows = artifacts.read_term_vectors(spark, f"file://{tmp_path}/v.npz")
    assert {(r["go_id"], tuple(r["embedding"]), r["release"]) for r in rows.collect()} == {("a", (1.0, 0.0, 0.0), "r1"), ("b", (0.0, 1.0, 0.0), "r1"), ("c", (0.0, 0.0, 1.0), "r1")}
    index = artifacts.get_index(spark, f"file://{tmp_path}/v.npz")
    assert index is artifacts.get_index(spark, f"file://{tmp_path}/v.npz")
    assert (len(index), index.dim, index.release, "a" in index, "z" in index, index.vec("b"), index.vec("z")) == (3, 3, "r1", True, False, [0.0, 1.0, 0.0], None)
    assert {r["go_id"]: r["embedding"] for r in index.batch(rows.select("go_id")).collect()}["c"] == [0.0, 0.0, 1.0]
    with pytest.raises(FileNotFoundError):
        artifacts.read_term_vectors(spark, f"file://{tmp_path}/none.npz")
    batch = {r["go_id"]: r for r in enrich.term_vector_batch(spark.createDataFrame([("a",), ("z",), (None,)], "go_id string"), rows, 3, zero_if_missing=False).collect()}
    assert batch["a"]["found"] and not batch["z"]["found"] and all(map(math.isnan, batch["z"]["embedding"]))


STUMP = score.TreeEnsemble([[score.Node("x", 1.0, 1, 2, False), score.Node(value=-2.0), score.Node(value=3.0)]], bias=0.25)


def test_scores_and_calibration(spark):
    rows = spark.createDataFrame([(1, "F", "0.5"), (2, "F", "2"), (3, "P", None), (4, "P", "text"), (5, "", "1")], "row long, aspect string, x string")
    got = {r["row"]: r["reranker_score"] for r in score.apply_reranker(rows, STUMP, calibration="never").collect()}
    assert got == {1: -1.75, 2: 3.25, 3: 3.25, 4: 3.25, 5: -1.75}
    auto = {r["row"]: r["reranker_score"] for r in score.apply_reranker(rows, STUMP).collect()}
    assert auto == pytest.approx({k: score.sigmoid(v) for k, v in got.items()})
    half = score.TreeEnsemble([[score.Node(value=0.5)]])
    by = {r["row"]: r["reranker_score"] for r in score.score_by_aspect(rows, {"F": STUMP, "P": half}).collect()}
    assert by == pytest.approx({1: score.sigmoid(-1.75), 2: score.sigmoid(3.25), 3: 0.5, 4: 0.5, 5: None}, nan_ok=True)
    assert score.load_from_bytes(STUMP.to_string().encode()) == STUMP
    assert score.apply_reranker(rows.limit(0), STUMP).count() == 0
    with pytest.raises(ValueError, match="ensemble"):
        score.model_from_string("tree")


def test_encodings_and_dataset(spark):
    rows = spark.createDataFrame([(1, "b", "1.5", 1), (2, "", "x", 0), (3, "a", None, 1), (4, "b", "2", 0), (5, None, "3", 1)], "row long, q string, n string, label long")
    codes = lambda df: [r["q"] for r in df.orderBy("row").collect()]
    assert codes(score.encode_factorize(rows, ["q"], "row")) == [0, -1, 1, 0, -1]
    assert codes(score.encode_factorize(rows, ["q"], "row", empty_is_missing=False)) == [0, 1, 2, 0, -1]
    assert codes(score.encode_vocabulary(rows, {"q": ["a", "b"]})) == [1, -1, 0, 1, -1]
    schema = FeatureSchema(("n", "k_context"), ("q", "plm_id"))
    out = score.prepare_dataset(rows, "row", schema)
    assert out.columns == ["row", "n", "q", "label"] and [r["n"] for r in out.orderBy("row").collect()] == [1.5, None, None, 2.0, 3.0]
    with pytest.raises(KeyError):
        score.prepare_dataset(rows.drop("n"), "row", schema)
    model = score.TreeEnsemble([[score.Node("q", 0.5, 1, 2), score.Node(value=0.1), score.Node(value=0.9)]])
    free = rows.drop("label")
    said = lambda **x: [r["reranker_score"] for r in score.predict_scores(free, model, "row", schema=schema, **x).orderBy("row").collect()]
    assert said() == [0.1, 0.9, 0.9, 0.1, 0.1] and said(categorical_codes={"q": ["a", "b"]}) == [0.9, 0.1, 0.1, 0.9, 0.1]
    assert [r["reranker_score"] for r in score.predict_scores(rows, model, "row", schema=schema).orderBy("row").collect()] == [0.1, 0.1, 0.9, 0.1, 0.1]


def test_families():
    assert infer_active_feature_families() == ["annotation_meta", "knn"]
    assert "taxonomy_pair" in infer_active_feature_families(compute_taxonomy=True)


def test_stream_equals_batch(spark, world, tmp_path):
    world["q"].repartition(2).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(world["q"].schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    sink = lambda rows, n: rows.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
    predict_stream(stream, world["r"], world["a"], world["t"], sink, f"{tmp_path}/state").awaitTermination()
    columns = ["query_pos", "go_term_id", "vote_count", "ref_protein_accession"]
    want = predict(world["q"], world["r"], world["a"], world["t"]).select(*columns)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select(*columns).collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(ValueError, match="calibration"):
        predict_stream(stream, world["r"], world["a"], world["t"], sink, f"{tmp_path}/x", model=STUMP)


def test_repeated_deliveries_vote_once(spark):
    rows = spark.createDataFrame([("R", 1, 5, "a", None), ("R", 1, 5, "a", "x"), ("R", 2, 5, None, None), (None, 1, 5, "a", "b")], "ref_accession string, ann_pos int, go_term_id long, qualifier string, evidence_code string")
    assert votes.distinct_annotations(rows).count() == 2
    assert votes.annotation_frequency(votes.distinct_annotations(rows)).select(F.sum("go_term_frequency")).first()[0] == 2


def test_pca_is_fitted_on_all_rows(spark):
    """60,000 rows, a third of them copies of one vector."""
    x = np.random.default_rng(21).normal(size=(40_000, 3)) * [1, 2, 3]
    x = np.concatenate([x, np.full((20_000, 3), [9.0, -4.0, 2.0])])
    rows = spark.createDataFrame(pa.table({"embedding": pa.array(list(x), pa.list_(pa.float64()))}))
    state = fit_embedding_pca(rows, 2)
    assert np.allclose(state.mean, x.mean(0), atol=1e-9)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(np.abs(np.array(state.components) @ vectors[:, ::-1][:, :2]), np.eye(2), atol=1e-6)


LIGHTGBM = """tree
version=v4
num_class=1
num_tree_per_iteration=1
label_index=0
max_feature_idx=2
objective=binary sigmoid:2
feature_names=x y c
feature_infos=[0:9] [0:9] 0:1:2:40
tree_sizes=1 1 1

Tree=0
num_leaves=3
num_cat=0
split_feature=0 1
threshold=1.5 0.25
decision_type=10 4
left_child=1 -1
right_child=-3 -2
leaf_value=0.1 0.2 -0.3
is_linear=0
shrinkage=0.1


Tree=1
num_leaves=2
num_cat=1
split_feature=2
threshold=0
decision_type=1
left_child=-1
right_child=-2
leaf_value=1 -1
cat_boundaries=0 2
cat_threshold=5 256
is_linear=0
shrinkage=0.1


Tree=2
num_leaves=2
num_cat=0
split_feature=1
threshold=3
decision_type=0
left_child=-1
right_child=-2
leaf_value=0.5 0.75
is_linear=0
shrinkage=0.1


Tree=3
num_leaves=1
num_cat=0
leaf_value=0.01
is_linear=0
shrinkage=1


end of trees

feature_importances:
x=1

parameters:
[boosting: gbdt]
end of parameters

pandas_categorical:null
"""


def plain_lightgbm(x, y, c):
    """The model above, read by hand: x has missing NaN and goes left by default, y has missing zero and goes right, then none."""
    zero = y is None or abs(y) <= 1e-35
    first = (0.2 if zero or not y <= 0.25 else 0.1) if x is None or x <= 1.5 else -0.3
    second = 1 if c is not None and int(c) in (0, 2, 40) and c > -1 else -1
    third = 0.5 if (y or 0.0) <= 3 else 0.75
    return score.sigmoid(2 * (first + second + third + 0.01))


@pytest.mark.parametrize("limit", [0, 1000])
def test_lightgbm_text(spark, monkeypatch, limit):
    """In batches and as CASE expressions."""
    monkeypatch.setattr(score, "CASE_NODES", limit)
    values = [(x, y, c) for x in (None, 1.5, 2.0) for y in (None, 0.0, 0.2, 0.3, 4.0) for c in (None, -3.0, 0.0, 1.0, 2.0, 40.0, 41.0, 1e9)]
    rows = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "row long, x double, y double, c double")
    model = score.load_from_bytes(LIGHTGBM.encode())
    assert model.feature_names() == ["x", "y", "c"] and score.model_from_string(model.to_string()) == model
    got = {r["row"]: r["reranker_score"] for r in score.apply_reranker(rows, model).collect()}
    assert got == pytest.approx({i: plain_lightgbm(*v) for i, v in enumerate(values)})
    assert score.model_from_string(score.to_lightgbm(model)) == model
    without = {r["row"]: r["reranker_score"] for r in score.apply_reranker(rows.drop("c"), model).collect()}
    assert without == pytest.approx({i: plain_lightgbm(x, y, None) for i, (x, y, _) in enumerate(values)})
    for wrong in (LIGHTGBM.replace("num_class=1", "num_class=3"), LIGHTGBM.replace("leaf_value=0.1 0.2 -0.3", "leaf_value=0.1"), LIGHTGBM.replace("is_linear=0", "is_linear=1"), "tree\n"):
        with pytest.raises(ValueError, match="ensemble"):
            score.model_from_string(wrong)


def forest(trees, leaves, features=12, seed=3):
    rng, out = np.random.default_rng(seed), []
    for _ in range(trees):
        nodes, open_ = [None], [0]
        while len(nodes) < 2 * leaves - 1:
            i = open_.pop(int(rng.integers(len(open_))))
            nodes[i] = score.Node(f"f{rng.integers(features)}", float(rng.normal()), len(nodes), len(nodes) + 1, bool(rng.integers(2)))
            open_ += [len(nodes), len(nodes) + 1]
            nodes += [None, None]
        out.append([n or score.Node(value=float(rng.normal())) for n in nodes])
    return score.TreeEnsemble(out)


def test_batches_and_cases_agree_to_the_bit(spark, monkeypatch):
    rows = spark.range(500).select("id", *[F.when(F.rand(i) > 0.1, F.randn(i)).alias(f"f{i}") for i in range(12)]).cache()
    model, got = forest(6, 9), []
    for limit in (0, 10_000):
        monkeypatch.setattr(score, "CASE_NODES", limit)
        got.append({r["id"]: r["reranker_score"] for r in score.apply_reranker(rows, model, calibration="never").collect()})
    assert got[0] == got[1] and len(set(got[0].values())) > 100


def test_written_models_are_read_as_they_were():
    shift = score.TreeEnsemble([[score.Node("x", 0.1, 1, 2, False, missing="zero"), score.Node(value=1 / 3), score.Node(value=-2.5)]], ["x"], 0.25, "exp")
    back = score.model_from_string(score.to_lightgbm(shift))
    assert back.trees == [[score.Node(value=0.25)], *shift.trees] and back.output == "exp"
    assert score.model_from_string(score.to_lightgbm(forest(20, 7))).trees[3] != []
    for output in ("raw", "sigmoid", "exp", "square", "mean"):
        one = score.TreeEnsemble([[score.Node(value=0.5)]], ["x"], output=output)
        assert score.model_from_string(score.to_lightgbm(one)) == one


def test_many_trees(spark):
    rows = spark.range(20_000).select("id", *[F.randn(i).alias(f"f{i}") for i in range(12)])
    began = time.time()
    assert score.apply_reranker(rows, forest(500, 31)).where("reranker_score between 0 and 1").count() == 20_000
    assert time.time() - began < 60


def test_external_model_in_predict(world):
    class Sum:
        def predict(self, frame):
            return frame.sum(axis=1).to_numpy()

    model = artifacts.external_scorer(Sum, ["vote_count", "k_position", "absent"])
    rows = predict(world["q"], world["r"], world["a"], world["t"], LabelTransferConfig(calibration="never"), model=model).collect()
    assert rows and all(r["reranker_score"] == r["vote_count"] + r["k_position"] for r in rows)
    bent = predict(world["q"], world["r"], world["a"], world["t"], models_by_aspect={"F": model}).collect()
    assert all(r["reranker_score"] == pytest.approx(score.sigmoid(r["vote_count"] + r["k_position"])) if r["aspect"] == "F" else r["reranker_score"] is None for r in bent)


def test_repeated_ids_do_not_multiply_rows(spark):
    pairs = spark.createDataFrame([("Q", "R", 0.5), ("Q", "R", 0.25)], "protein_accession string, ref_accession string, identity_nw double")
    rows = spark.createDataFrame([("Q", "R")], "protein_accession string, ref_protein_accession string")
    assert [r["identity_nw"] for r in votes.with_pair_features(rows, pairs).collect()] == [0.25]
    assert votes.with_pair_features(rows, pairs.drop("identity_nw")).count() == 1
    vectors = spark.createDataFrame([("a", [2.0]), ("a", [1.0])], "go_id string, embedding array<float>")
    assert [r["embedding"] for r in enrich.term_vector_batch(spark.createDataFrame([("a",), ("a",)], "go_id string"), vectors, 1).collect()] == [[1.0]]


def test_odd_length_first(spark, world):
    """A reference of another length in front changes nothing, and a query without a vector is said."""
    odd = spark.createDataFrame([(-1, "ODD", [1.0, 2.0])], world["r"].schema)
    columns = ["query_pos", "go_term_id", "vote_count", "ref_protein_accession"]
    want = sorted(map(tuple, predict(world["q"], world["r"], world["a"], world["t"]).select(*columns).collect()))
    for config in (LabelTransferConfig(), LabelTransferConfig(dim=6)):
        assert sorted(map(tuple, predict(world["q"], odd.unionByName(world["r"]), world["a"], world["t"], config).select(*columns).collect())) == want
    assert np.allclose(fit_embedding_pca(odd.unionByName(world["r"]), 2).components, fit_embedding_pca(world["r"], 2).components)
    short = spark.createDataFrame([(9, "Q9", [1.0])], world["q"].schema)
    with pytest.warns(UserWarning, match="1 of 4 queries"):
        predict(world["q"].unionByName(short), world["r"], world["a"], world["t"])


def test_lost_queries_are_refused(spark, world):
    from kinvote.operators import transfer

    near = spark.createDataFrame([(0,)], "query_pos long")
    with pytest.raises(RuntimeError, match="2 of 3"):
        transfer.check_answers(world["q"], near, 6, LabelTransferConfig())
    with pytest.warns(UserWarning, match="2 of 3"):
        transfer.check_answers(world["q"], near, 6, LabelTransferConfig(strategy="lsh"))
    transfer.check_answers(world["q"], near, 6, LabelTransferConfig(distance_threshold=0.1))


def test_intermediate_tables(spark):
    from kinvote.sources import scratch

    with scratch.scope():
        table = scratch.cut(spark.range(5), "five")
        at = table._kinvote_path
        assert table.count() == 5 and at.startswith(spark.conf.get("spark.checkpoint.dir"))
    assert not artifacts._exists(spark, at)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from kinvote.sources import scratch

    nothing = SimpleNamespace(get=lambda *a: None)
    context = SimpleNamespace(getConf=lambda: nothing, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="checkpoint"):
        scratch.folder(SimpleNamespace(conf=nothing, sparkContext=context))
