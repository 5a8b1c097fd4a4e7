"""TreeSHAP against brute-force Shapley values (cover-weighted conditional expectations)."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from pdforge.operators import explain as EX


def _cond_expectation(tree, x, subset, j=0):
    """E[f(x) | x_S] for one flattened tree: follow x on features in S, average by cover otherwise."""
    left, right = tree["left"][j], tree["right"][j]
    if left < 0:
        return tree["value"][j]
    f = tree["feature"][j]
    if f in subset:
        go_left = (x[f] in tree["cats"][j]) if tree["cats"][j] is not None else x[f] <= tree["threshold"][j]
        return _cond_expectation(tree, x, subset, left if go_left else right)
    c = tree["cover"]
    return (c[left] * _cond_expectation(tree, x, subset, left)
            + c[right] * _cond_expectation(tree, x, subset, right)) / c[j]


def _brute_force(trees, x, m):
    phi = np.zeros(m)
    for i in range(m):
        others = [k for k in range(m) if k != i]
        for r in range(len(others) + 1):
            for s in itertools.combinations(others, r):
                w = math.factorial(len(s)) * math.factorial(m - len(s) - 1) / math.factorial(m)
                with_i = sum(_cond_expectation(t, x, set(s) | {i}) for t in trees)
                without = sum(_cond_expectation(t, x, set(s)) for t in trees)
                phi[i] += w * (with_i - without)
    return phi


def test_tree_shap_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    n = 400
    a, b, c = rng.normal(size=n), rng.normal(size=n), rng.integers(0, 4, n).astype(float)
    y = ((a + 0.5 * b * c + rng.normal(scale=0.5, size=n)) > 0.5).astype(int)
    rows = [(i, float(a[i]), float(b[i]), float(c[i]), int(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "loan_id long, a double, b double, c double, label int")
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    model = GBTClassifier(maxIter=4, maxDepth=3, seed=1).fit(df)
    trees = EX.tree_tables(model)
    got = {(r.loan_id, r.feature): r.phi for r in EX.tree_shap_frame(df.where("loan_id < 15"), model, ["a", "b", "c"])
           .collect()}
    for r in df.where("loan_id < 15").select("loan_id", vector_to_array("features").alias("x")).collect():
        want = _brute_force(trees, np.asarray(r.x), 3)
        for k, name in enumerate(["a", "b", "c"]):
            assert got[(r.loan_id, name)] == pytest.approx(want[k], abs=1e-9)
    # base value equals the cover-weighted expectation with no feature known
    base = {r.loan_id: r.phi for r in EX.tree_shap_frame(df.where("loan_id = 0"), model, ["a", "b", "c"])
            .where(F.col("feature") == "__base__").collect()}
    assert base[0] == pytest.approx(sum(_cond_expectation(t, np.zeros(3), set()) for t in trees), abs=1e-12)


def _grown(rng, depth, features):
    """A random tree in MLlib's order with covers that add up; a few nodes split by levels."""
    t = {k: [] for k in ("feature", "threshold", "left", "right", "value", "cover", "cats")}

    def put(level, cover):
        at = len(t["left"])
        leaf = level == 0 or (level < depth and rng.random() < 0.15)
        levels = set(rng.choice(4, 2, replace=False).tolist()) if rng.random() < 0.2 else None
        for k, v in (("feature", -1 if leaf else int(rng.integers(features))), ("threshold", float(rng.integers(0, 4))), ("left", -1), ("right", -1),
                     ("value", float(rng.normal())), ("cover", float(cover)), ("cats", None if leaf else levels)):
            t[k].append(v)
        if not leaf:
            share = rng.uniform(0.2, 0.8)
            t["left"][at] = put(level - 1, cover * share)
            t["right"][at] = put(level - 1, cover * (1 - share))
        return at

    put(depth, 1000.0)
    return {k: v if k == "cats" else np.array(v) for k, v in t.items()}


@pytest.mark.parametrize("depth", [0, 2, 5, 11])
def test_pieces_of_a_tree_give_the_values_of_its_leaves(depth, monkeypatch):
    """One look-up a piece stands for one a leaf; paths longer than a piece keep their leaves."""
    rng = np.random.default_rng(depth)
    x = rng.integers(0, 5, (50, 7)).astype(float)
    for tree in (_grown(rng, depth, 7) for _ in range(3)):
        pieces, long = EX.piece_tables(tree)
        leaves = int((tree["left"] < 0).sum())
        assert len(pieces) < max(2, leaves) and all(len(nodes) <= EX.PIECE_NODES for nodes, _, _ in pieces)
        assert bool(long) == (depth > EX.PIECE_NODES)
        want, got = np.zeros((50, 7)), np.zeros((7, 50))
        EX.tree_shap(tree, EX.leaf_tables(tree), x, want)
        EX.tree_shap_columns(tree, pieces, long, np.ascontiguousarray(x.T), got)
        assert np.abs(got.T - want).max() < 1e-12
