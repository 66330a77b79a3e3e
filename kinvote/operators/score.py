"""Tree ensembles over feature columns, calibration, and model inputs."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from functools import cached_property, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinvote.schema import FeatureSchema

CALIBRATIONS = ("auto", "always", "never")
#: Nodes up to which an ensemble becomes CASE expressions; generated code has a size limit, beyond which Spark interprets it.
CASE_NODES = 256
#: Rows that are walked through the trees at a time.
STEP = 8192
#: What counts as zero where zeros are missing values.
ZERO = 1e-35
MISSING = ("none", "zero", "nan")


@dataclass(frozen=True)
class Node:
    """A split (``feature`` <= ``threshold`` goes left) or, without a feature, a leaf.

    Null and NaN go left if ``default_left`` where ``missing`` is "nan"; with
    "zero" they and zeros do, with "none" they are read as 0. With
    ``categories`` the feature is a code and those codes go left, all else,
    null included, goes right.
    """

    feature: str | None = None
    threshold: float = 0.0
    left: int = -1
    right: int = -1
    default_left: bool = True
    value: float = 0.0
    missing: str = "nan"
    categories: tuple[int, ...] | None = None

    def goes_left(self, x: Column) -> Column:
        null = x.isNull() | F.isnan(x)
        if self.categories is not None:
            return ~null & (x > -1) & F.coalesce(x.cast("long").isin(*self.categories), F.lit(False))
        if self.missing == "nan":
            return F.when(null, F.lit(self.default_left)).otherwise(x <= self.threshold)
        known = F.when(null, F.lit(0.0)).otherwise(x)
        if self.missing == "none":
            return known <= self.threshold
        return F.when(F.abs(known) <= ZERO, F.lit(self.default_left)).otherwise(known <= self.threshold)


class FlatTrees:
    """All nodes of an ensemble in arrays; a leaf is its own child."""

    def __init__(self, trees: list[list[Node]], names: list[str]) -> None:
        place = {n: i for i, n in enumerate(names)}
        nodes = [n for t in trees for n in t]
        base = np.repeat(np.cumsum([0, *map(len, trees)])[:-1], [len(t) for t in trees]).astype(np.int64)
        leaf = np.array([n.feature is None for n in nodes], bool)
        own = np.arange(len(nodes))
        self.roots = np.cumsum([0, *map(len, trees)])[:-1]
        self.depths = [_depth(t) for t in trees]
        self.feature = np.array([-1 if n.feature is None else place.get(n.feature, len(names)) for n in nodes]).clip(0)
        self.threshold = np.array([n.threshold for n in nodes], "f8")
        self.left = np.where(leaf, own, base + np.array([n.left for n in nodes]))
        self.right = np.where(leaf, own, base + np.array([n.right for n in nodes]))
        self.default = np.array([n.default_left for n in nodes], bool)
        self.value = np.array([n.value for n in nodes], "f8")
        kinds = [MISSING.index(n.missing) for n in nodes]
        self.missing = np.array(kinds)
        sets = sorted({n.categories for n in nodes if n.categories is not None})
        self.sets = np.zeros((len(sets), 1 + max((max(c, default=0) for c in sets), default=0)), bool)
        for row, codes in zip(self.sets, sets):
            row[list(codes)] = True
        self.own_set = np.array([-1 if n.categories is None else sets.index(n.categories) for n in nodes])
        self.mixed = bool(sets) or any(MISSING[k] != "nan" for k, f in zip(kinds, leaf) if not f)

    def __call__(self, x: np.ndarray, start: float) -> np.ndarray:
        """``start`` plus the leaf values of every row, added in the order of the trees."""
        x = np.column_stack([x, np.full(len(x), np.nan)])  # the last column stands for features that are not given
        out = np.full(len(x), start)
        for lo in range(0, len(x), STEP):
            part, rows = x[lo : lo + STEP], np.arange(min(STEP, len(x) - lo))
            for root, depth in zip(self.roots, self.depths):
                at = np.full(len(rows), root)
                for _ in range(depth):
                    at = np.where(self._left(part[rows, self.feature[at]], at), self.left[at], self.right[at])
                out[lo : lo + STEP] += self.value[at]
        return out

    def _left(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        null = np.isnan(value)
        if not self.mixed:
            return np.where(null, self.default[at], value <= self.threshold[at])
        known, kind = np.where(null, 0.0, value), self.missing[at]
        by_default = ((kind == 2) & null) | ((kind == 1) & (np.abs(known) <= ZERO))
        left = np.where(by_default, self.default[at], known <= self.threshold[at])
        coded = self.own_set[at]
        if len(self.sets):
            code = known.clip(-1, self.sets.shape[1]).astype(np.int64)
            fine = ~null & (known > -1) & (code < self.sets.shape[1])
            left = np.where(coded < 0, left, fine & self.sets[coded.clip(0), np.where(fine, code, 0)])
        return left


def _depth(tree: list[Node]) -> int:
    """Most splits on a way from the root to a leaf."""
    deepest, todo = 0, [(0, 0)]
    while todo:
        i, d = todo.pop()
        deepest = max(deepest, d)
        if tree[i].feature is not None:
            todo += [(tree[i].left, d + 1), (tree[i].right, d + 1)]
    return deepest


@dataclass(frozen=True)
class TreeEnsemble:
    """Trees of nodes (root first) whose leaf values add up to the raw score.

    ``output`` is what becomes of the sum: "raw", "sigmoid" (of ``slope`` times
    it), "exp", "square" (with its sign) or "mean" (over the trees).
    """

    trees: list[list[Node]]
    features: list[str] = field(default_factory=list)
    bias: float = 0.0
    output: str = "raw"
    slope: float = 1.0

    def feature_names(self) -> list[str]:
        return self.features or sorted({n.feature for t in self.trees for n in t if n.feature is not None})

    @cached_property
    def flat(self) -> FlatTrees:
        return FlatTrees(self.trees, self.feature_names())

    def raw(self, columns: dict[str, Column]) -> Column:
        """The score over feature columns; a feature that is not given is missing.

        Small ensembles become nested CASE expressions and stay in generated
        code; larger ones are walked in Arrow batches over flat arrays. Both add
        the same numbers in the same order.
        """
        small = sum(map(len, self.trees)) <= CASE_NODES
        total = self._cases(columns) if small else self._batched(columns)
        if self.output == "sigmoid":
            return 1 / (1 + F.exp(-self.slope * total))
        if self.output == "exp":
            return F.exp(total)
        if self.output == "square":
            return F.signum(total) * total * total
        return total / len(self.trees) if self.output == "mean" else total

    def _cases(self, columns: dict[str, Column]) -> Column:
        def walk(tree: list[Node], i: int) -> Column:
            node = tree[i]
            if node.feature is None:
                return F.lit(float(node.value))
            x = columns.get(node.feature, F.lit(None).cast("double"))
            return F.when(node.goes_left(x), walk(tree, node.left)).otherwise(walk(tree, node.right))

        return reduce(lambda a, b: a + b, [walk(t, 0) for t in self.trees], F.lit(float(self.bias)))

    def _batched(self, columns: dict[str, Column]) -> Column:
        from pyspark import SparkContext

        names = self.feature_names()
        given = [c for c in names if c in columns]
        # A model is an artifact of bounded size: some hundred trees are well below a megabyte.
        known = SparkContext._active_spark_context.broadcast((self.flat, [names.index(c) for c in given], len(names), float(self.bias)))

        @F.pandas_udf("double")
        def score(*values: pd.Series) -> pd.Series:
            trees, places, width, bias = known.value
            x = np.full((len(values[0]), width), np.nan)
            for i, v in zip(places, values):
                x[:, i] = v.to_numpy("f8", na_value=np.nan)
            return pd.Series(trees(x, bias))

        return score(*([columns[c] for c in given] or [F.lit(None).cast("double")]))

    def to_string(self) -> str:
        return json.dumps(asdict(self))


class ExternalModel:
    """A model object of another library, scored in Arrow batches.

    ``load()`` runs once per task and gives something with ``predict`` for a
    frame of ``features``, all of them numbers; the library must be installed on
    the executors, and its import belongs into ``load``.
    """

    def __init__(self, load: Callable, features: list[str]) -> None:
        self.load, self.features = load, list(features)

    def feature_names(self) -> list[str]:
        return self.features

    def raw(self, columns: dict[str, Column]) -> Column:
        load, features = self.load, self.features

        @F.pandas_udf("double")
        def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            model = load()
            for values in batches:
                yield pd.Series(np.asarray(model.predict(pd.concat(values, axis=1, keys=features).astype("float64")), "f8"))

        return score(*[columns.get(c, F.lit(None).cast("double")) for c in features])


Model = TreeEnsemble | ExternalModel


def model_from_string(text: str) -> TreeEnsemble:
    """The ensemble that ``to_string`` wrote, or one in the text format of LightGBM."""
    try:
        if text.lstrip().startswith("tree"):
            return _from_lightgbm(text)
        said = json.loads(text)
        trees = [[Node(**(n | {"categories": None if n.get("categories") is None else tuple(n["categories"])})) for n in t] for t in said["trees"]]
        return TreeEnsemble(trees, said.get("features", []), said.get("bias", 0.0), said.get("output", "raw"), said.get("slope", 1.0))
    except (ValueError, KeyError, TypeError, IndexError) as x:
        raise ValueError(f"not a tree ensemble: {x}") from x


def _from_lightgbm(text: str) -> TreeEnsemble:
    """Read the published text format: a header, one section per tree, then lines that do not matter here.

    Inner nodes and leaves are numbered apart, a child below 0 is leaf -1 - child;
    ``decision_type`` has the bits categorical, default left and two for the
    missing type; the threshold of a categorical split counts the bit sets in ``cat_threshold``.
    """
    body = text.split("end of trees")[0]
    head, *sections = body.split("\nTree=")
    said = _lines(head)
    names = said["feature_names"].split()
    if int(said.get("num_class", 1)) != 1 or int(said.get("num_tree_per_iteration", 1)) != 1:
        raise ValueError("models of several classes are not supported")
    objective = said.get("objective", "").split()
    kind, options = (objective or [""])[0], dict(o.split(":", 1) for o in objective if ":" in o)
    # What the objectives of the format make of the sum.
    outputs = {"binary": "sigmoid", "cross_entropy": "sigmoid", "xentropy": "sigmoid", "poisson": "exp", "gamma": "exp", "tweedie": "exp"}
    output = "square" if kind == "regression" and "sqrt" in objective else outputs.get(kind, "raw")
    if "average_output" in head.split():
        if output != "raw":
            raise ValueError("averaged models with an output function are not supported")
        output = "mean"
    trees = []
    for section in sections:
        own = _lines(section)
        if own.get("is_linear", "0") != "0":
            raise ValueError("linear leaves are not supported")
        number = lambda key, kind: [kind(x) for x in own.get(key, "").split()]  # noqa: E731, B023
        leaves = number("leaf_value", float)
        left, right = number("left_child", int), number("right_child", int)
        inner, ends, words = len(left), number("cat_boundaries", int), number("cat_threshold", int)
        place = lambda child: child if child >= 0 else inner - 1 - child  # noqa: E731, B023
        tree = []
        for i, (feature, threshold, how) in enumerate(zip(number("split_feature", int), number("threshold", float), number("decision_type", int), strict=True)):
            codes = None
            if how & 1:
                bits = words[ends[int(threshold)] : ends[int(threshold) + 1]]
                codes = tuple(32 * w + b for w, word in enumerate(bits) for b in range(32) if word >> b & 1)
            tree.append(Node(names[feature], 0.0 if how & 1 else threshold, place(left[i]), place(right[i]), bool(how & 2), missing=MISSING[how >> 2 & 3], categories=codes))
        if len(tree) != inner or len(leaves) != inner + 1:
            raise ValueError("a tree has another number of nodes than it says")
        trees.append([*tree, *(Node(value=v) for v in leaves)])
    if not trees:
        raise ValueError("no trees")
    return TreeEnsemble(trees, names, 0.0, output, float(options.get("sigmoid", 1.0)))


def to_lightgbm(model: TreeEnsemble) -> str:
    """The ensemble in that format, with what predictions need; a bias becomes a tree of one leaf."""
    names = model.feature_names()
    objectives = {"raw": "regression", "sigmoid": f"binary sigmoid:{model.slope:.17g}", "exp": "poisson", "square": "regression sqrt", "mean": "regression"}
    head = ["tree", "version=v4", "num_class=1", "num_tree_per_iteration=1", "label_index=0", f"max_feature_idx={len(names) - 1}", f"objective={objectives[model.output]}"]
    out = [*head, *(["average_output"] if model.output == "mean" else []), f"feature_names={' '.join(names)}", ""]
    for k, tree in enumerate(([[Node(value=model.bias)]] if model.bias else []) + model.trees):
        inner, leaves = [i for i, n in enumerate(tree) if n.feature is not None], [i for i, n in enumerate(tree) if n.feature is None]
        place = {i: k for k, i in enumerate(inner)} | {i: -1 - k for k, i in enumerate(leaves)}
        sets = [tree[i].categories for i in inner if tree[i].categories is not None]
        words = [[sum(1 << c % 32 for c in own if c // 32 == w) for w in range(1 + max(own, default=0) // 32)] for own in map(set, sets)]
        coded = iter(range(len(sets)))
        lines = {
            "num_leaves": [len(leaves)], "num_cat": [len(sets)],
            "split_feature": [names.index(tree[i].feature) for i in inner],
            "threshold": [f"{tree[i].threshold:.17g}" if tree[i].categories is None else next(coded) for i in inner],
            "decision_type": [(tree[i].categories is not None) | tree[i].default_left << 1 | MISSING.index(tree[i].missing) << 2 for i in inner],
            "left_child": [place[tree[i].left] for i in inner], "right_child": [place[tree[i].right] for i in inner],
            "leaf_value": [f"{tree[i].value:.17g}" for i in leaves],
            **({"cat_boundaries": np.cumsum([0, *map(len, words)]).tolist(), "cat_threshold": sum(words, [])} if sets else {}),
            "is_linear": [0], "shrinkage": [1],
        }
        out += [f"Tree={k}", *(f"{key}={' '.join(map(str, values))}" for key, values in lines.items()), "", ""]
    return "\n".join([*out, "end of trees", ""])


def _lines(section: str) -> dict[str, str]:
    return dict(line.split("=", 1) for line in section.splitlines() if "=" in line)


def load_from_bytes(data: bytes) -> TreeEnsemble:
    """The same from UTF-8 bytes."""
    return model_from_string(data.decode("utf-8"))


def model_from_table(nodes: DataFrame) -> TreeEnsemble:
    """An ensemble from rows (tree, node, feature, threshold, left, right, default_left, value); a model is small."""
    trees: dict[int, dict[int, Node]] = {}
    for r in nodes.collect():
        trees.setdefault(r["tree"], {})[r["node"]] = Node(r["feature"], r["threshold"] or 0.0, r["left"] if r["left"] is not None else -1, r["right"] if r["right"] is not None else -1, bool(r["default_left"]), r["value"] or 0.0)
    return TreeEnsemble([[t[i] for i in sorted(t)] for _, t in sorted(trees.items())])


def _number(rows: DataFrame, column: str) -> Column:
    """A column as a number: text that is none becomes null."""
    return F.col(column).try_cast("double")


def _calibrated(rows: DataFrame, raw: str, out: str, group: str | None, calibration: str) -> DataFrame:
    """Turn raw scores into 0..1 by the logistic function if any of the batch (or group) lies outside.

    The extremes are aggregated first, with partial aggregation, and joined
    back: one row per model.
    """
    if calibration not in CALIBRATIONS:
        raise ValueError(f"unknown calibration {calibration!r}; one of {', '.join(CALIBRATIONS)}")
    bent = 1 / (1 + F.exp(-F.col(raw)))
    if calibration != "auto":
        return rows.withColumn(out, bent if calibration == "always" else F.col(raw)).drop(raw)
    outside = F.max((F.col(raw) < 0) | (F.col(raw) > 1)).alias("_outside")
    if group is None:
        joined = rows.join(F.broadcast(rows.agg(outside)))  # one row
    else:
        joined = rows.join(rows.groupBy(group).agg(outside), group, "left")
    return joined.withColumn(out, F.when(F.col("_outside"), bent).otherwise(F.col(raw))).drop(raw, "_outside")


def apply_reranker(rows: DataFrame, model: Model, feature_cols: list[str] | None = None, calibration: str = "auto", out: str = "reranker_score") -> DataFrame:
    """``rows`` with the model's score.

    Features are ``feature_cols`` or the model's own; columns that are missing
    count as missing values, all others are read as numbers, so text categories
    become missing too.
    """
    names = feature_cols or model.feature_names()
    columns = {c: _number(rows, c) for c in names if c in rows.columns}
    return _calibrated(rows.withColumn("_raw", model.raw(columns)), "_raw", out, None, calibration)


def score_by_aspect(rows: DataFrame, models: dict[str, Model], feature_cols: list[str] | None = None, calibration: str = "auto", out: str = "reranker_score") -> DataFrame:
    """Every row scored by the model of its aspect; null where there is none. Each aspect is calibrated by itself."""
    raw = F.lit(None).cast("double")
    for aspect, model in models.items():
        names = feature_cols or model.feature_names()
        raw = F.when(F.col("aspect") == aspect, model.raw({c: _number(rows, c) for c in names if c in rows.columns})).otherwise(raw)
    return _calibrated(rows.withColumn("_raw", raw), "_raw", out, "aspect", calibration)


def encode_factorize(rows: DataFrame, columns: list[str], row_pos: str, empty_is_missing: bool = True) -> DataFrame:
    """Replace each of ``columns`` by codes 0, 1, ... in the order of first appearance by ``row_pos``; missing is -1.

    The distinct values of a column are ranked in one task, one small row each;
    for columns with very many of them give a vocabulary instead.
    """
    out = rows
    for c in columns:
        value = F.nullif(F.col(c), F.lit("")) if empty_is_missing else F.col(c)
        keyed = out.withColumn("_v", value)
        first = keyed.where("_v is not null").groupBy("_v").agg(F.min(row_pos).alias("_first"))
        # One row per category: the ranking is over the vocabulary, not over the rows.
        codes = first.select("_v", (F.row_number().over(Window.orderBy("_first", "_v")) - 1).cast("int").alias("_code"))
        out = keyed.join(codes, "_v", "left").withColumn(c, F.coalesce("_code", F.lit(-1))).drop("_v", "_code")
    return out


def encode_vocabulary(rows: DataFrame, vocabularies: dict[str, list[str]]) -> DataFrame:
    """Replace columns by the place of their value in a given vocabulary; null and unknown are -1."""
    out = rows
    for c, words in vocabularies.items():
        place = F.array_position(F.array(*map(F.lit, words)), F.col(c)) if words else F.lit(0)
        out = out.withColumn(c, (F.coalesce(place, F.lit(0)) - 1).cast("int"))
    return out


def prepare_dataset(rows: DataFrame, row_pos: str, schema: FeatureSchema = FeatureSchema()) -> DataFrame:
    """Features and label of a training table: numbers, category codes, ``label`` as an integer.

    A missing required column raises KeyError; pool-injected ones may be absent.
    """
    missing = [c for c in (*schema.required, schema.label) if c not in rows.columns]
    if missing:
        raise KeyError(f"missing columns: {', '.join(missing)}")
    present = [c for c in schema.all if c in rows.columns]
    numbers = [c for c in present if c in schema.numeric]
    coded = encode_factorize(rows, [c for c in present if c in schema.categorical], row_pos)
    return coded.withColumns({c: _number(coded, c) for c in numbers}).select(row_pos, *present, F.col(schema.label).cast("int").alias(schema.label))


def predict_scores(rows: DataFrame, model: Model, row_pos: str, categorical_codes: dict[str, list[str]] | None = None, schema: FeatureSchema = FeatureSchema(), calibration: str = "auto", out: str = "reranker_score") -> DataFrame:
    """``rows`` with a score from encoded features.

    With a label column the input is prepared like a training table. Without
    one, categories are coded by the given vocabulary, or by first appearance
    where it has none; an empty text is then a category like any other.
    """
    names = model.feature_names()
    if schema.label in rows.columns:
        coded = prepare_dataset(rows, row_pos, schema)
    else:
        codes = {c: v for c, v in (categorical_codes or {}).items() if c in names and c in rows.columns}
        coded = encode_vocabulary(rows, codes)
        coded = encode_factorize(coded, [c for c in names if c in schema.categorical and c in rows.columns and c not in codes], row_pos, empty_is_missing=False)
    columns = {c: _number(coded, c) for c in names if c in coded.columns}
    scored = _calibrated(coded.select(row_pos, model.raw(columns).alias("_raw")), "_raw", out, None, calibration)
    return rows.join(scored, row_pos)


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x))
