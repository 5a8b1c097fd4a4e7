"""Boosted trees over binned columns against MLlib's own."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import functions as F

from pdforge.operators import boosting as B
from pdforge.session import scratch_path


def _rows(spark, n=3000, weights=(1.0, 2.37)):
    rng = np.random.default_rng(11)
    a, b, few = rng.normal(size=n), rng.exponential(size=n).round(2), rng.integers(0, 3, n)
    k = rng.choice(["car", "home", "debt", "boat", "art"], n)
    y = (a + (k == "car") - 0.4 * b + 0.3 * few + rng.normal(scale=1.5, size=n) > 0.4).astype(int)
    w = rng.choice(weights, n) if len(weights) > 2 else np.array(weights)[y]
    df = spark.createDataFrame([(i, float(a[i]), float(b[i]), float(few[i]), 1.5, str(k[i]), int(y[i]), float(w[i])) for i in range(n)],
                               "loan_id long, a double, b double, few double, fixed double, k string, label int, weight double")
    df = StringIndexer(inputCol="k", outputCol="k_idx", handleInvalid="keep").fit(df).transform(df.repartition(3, "loan_id").sortWithinPartitions("loan_id"))
    df = VectorAssembler(inputCols=["a", "b", "few", "fixed", "k_idx"], outputCol="features").transform(df)
    path = scratch_path(spark, "boosting_rows")
    df.write.parquet(path)
    return spark.read.parquet(path)


def _nodes(spark, model):
    path = scratch_path(spark, "boosting_nodes")
    model.save(path)
    return spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect(), list(model.treeWeights)


PARAMS = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight", "maxIter": 8, "stepSize": 0.3, "maxDepth": 4, "minInstancesPerNode": 20,
          "subsamplingRate": 0.8, "featureSubsetStrategy": "0.6", "maxBins": 32, "seed": 5}


@pytest.mark.parametrize("cells", [B.CELLS, 200])  # the second: a level takes several passes
@pytest.mark.parametrize("weights", [(1.0, 2.37), (1.0, 0.5, 3.0, 2.0)])
def test_trees_are_those_of_mllib(spark, monkeypatch, cells, weights):
    rows = _rows(spark, weights=weights)
    monkeypatch.setattr(B, "MLLIB_ROWS", 0)
    monkeypatch.setattr(B, "CELLS", cells)
    monkeypatch.setattr(B, "ROWS", 700)
    want, want_weights = _nodes(spark, GBTClassifier(**PARAMS).fit(rows))
    model = B.BoostedTrees(**PARAMS).fit(rows)
    got, got_weights = _nodes(spark, model)
    assert got_weights == want_weights and len(got) == len(want) > 100
    for x, y in zip(got, want):
        assert (x.treeID, x.id, x.leftChild, x.rightChild, x.rawCount, x.split) == (y.treeID, y.id, y.leftChild, y.rightChild, y.rawCount, y.split)
        assert [x.prediction, x.impurity, x.gain, *x.impurityStats] == pytest.approx([y.prediction, y.impurity, y.gain, *y.impurityStats], rel=1e-9, abs=1e-9)
    assert any(x.split.numCategories > 0 for x in got)
    assert model.transform(rows).where(F.col("probability").isNull()).count() == 0 and model.getMaxIter() == 8


def test_many_rows_take_one_job_a_level_few_mllib(spark, monkeypatch):
    rows, jobs = _rows(spark), {}
    own = B.boosted
    monkeypatch.setattr(B, "boosted", lambda passed, shape, plan: own(lambda work: jobs.update(n=jobs.get("n", 0) + 1) or passed(work), shape, plan))
    few = B.BoostedTrees(**PARAMS).fit(rows)
    assert not jobs and _nodes(spark, few) == _nodes(spark, GBTClassifier(**PARAMS).fit(rows))
    monkeypatch.setattr(B, "MLLIB_ROWS", 2999)
    B.BoostedTrees(**PARAMS).fit(rows)
    assert 0 < jobs["n"] <= PARAMS["maxIter"] * PARAMS["maxDepth"] + 1


def test_draws_do_not_depend_on_the_lanes(spark):
    """A long run of the sampler in many lanes begins with a short run's in one."""
    long, short = B.drawn(77, 20000, 0.8), B.drawn(77, 200, 0.8)
    assert (long[:200] == short).all() and 0.78 < long.mean() < 0.82 and B.drawn(1, 5, 1.0).all()


def test_one_class_and_constant_columns(spark, monkeypatch):
    monkeypatch.setattr(B, "MLLIB_ROWS", 0)
    rows = _rows(spark, 200).withColumn("label", F.lit(1))
    model = B.BoostedTrees(**{**PARAMS, "maxIter": 2}).fit(rows)
    assert {r.numNodes for r in model.trees} == {1} and model.transform(rows).where("prediction = 1").count() == 200
