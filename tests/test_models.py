"""Model operator rules: champion tie-break, seeded draws, regularisation mapping, missing indicators."""

import pytest
from pyspark.sql import functions as F

from paths import SF001
from pdforge.operators import models as MD


class _M:
    def __init__(self, name, auc):
        self.name, self.test_metrics = name, {"roc_auc": auc}


def test_champion_ties_go_to_trees():
    gbt, lr = _M("Gradient-Boosted Trees", 0.7), _M("Logistic Regression", 0.7)
    assert MD.champion([gbt, lr]).name == "Gradient-Boosted Trees"
    assert MD.champion([gbt, _M("Logistic Regression", 0.71)]).name == "Logistic Regression"


def test_draws_are_seeded_and_in_range():
    a, b = MD.lr_param_draws(30, 42), MD.lr_param_draws(30, 42)
    assert a == b and all(0.001 <= d["C"] <= 10 and d["max_iter"] in (500, 1000) for d in a)
    g = MD.gbt_param_draws(10, 42)
    assert g == MD.gbt_param_draws(10, 42)
    assert all(0.01 <= d["learning_rate"] <= 0.3 and 0.5 <= d["subsample"] <= 1.0 for d in g)


def test_regularisation_maps_inverse_strength(spark):
    spec = MD.ModelSpec(["x"], [], [])
    lr = MD.lr_pipeline(spec, C=0.5, weight_total=200.0).getStages()[-1]
    assert lr.getRegParam() == pytest.approx(1.0 / (0.5 * 200.0))
    assert lr.getStandardization() is False and lr.getElasticNetParam() == 0.0


def test_missing_values_get_indicators(spark):
    df = spark.createDataFrame([(1.0, 1), (None, 0)], "x double, label int")
    spec = MD.infer_spec(df)
    assert spec.filled == ["x"]
    out = MD.fill_missing(df, spec).collect()
    assert [(r.x, r.x_missing) for r in out] == [(1.0, 0.0), (0.0, 1.0)]


def test_balanced_weights_sum_to_rows(spark):
    from pdforge.plans.catalog_models import _split, model_data
    f, spec = model_data(spark, SF001)
    w, total = MD.balanced_weights(_split(f, "train"))
    s = w.agg(F.sum("weight").alias("s"), F.count(F.lit(1)).alias("n")).first()
    assert s.s == pytest.approx(s.n) and total == s.n


def test_models_evaluated_together_have_their_own_test_metrics(spark):
    """Two fitted models in one curve pass get what each gets alone."""
    import random
    rng = random.Random(2)
    rows = [(float(y) + rng.gauss(0, 1), rng.gauss(0, 1), "AB"[rng.randrange(2)], y) for y in [0, 1] * 150]
    df = spark.createDataFrame(rows, "x double, z double, grade string, label int")
    models = []
    for numeric in (["x"], ["z"]):
        spec = MD.ModelSpec(numeric, ["grade"])
        models.append(MD.train_logistic_regression(df, df, spec))
    MD.evaluate_together(models, df)
    for m in models:
        assert m.test_metrics == MD.evaluate(m.model, MD.fill_missing(df, m.spec), m.threshold) == m.val_metrics
    assert MD.champion(models) is models[0]


def test_model_rows_are_cleaned_once_and_spread_over_the_cores(spark, monkeypatch):
    from pdforge.plans import catalog_models as CMo
    calls = []
    monkeypatch.setattr(CMo, "_SAVED", {})
    monkeypatch.setattr(CMo, "features", lambda s, d, _f=CMo.features: calls.append(d) or _f(s, d).coalesce(1))
    f, spec = CMo.model_data(spark, SF001)
    again, spec_again = CMo.model_data(spark, SF001)
    assert len(calls) == 1 and spec == spec_again and f.schema == again.schema
    assert f.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    monkeypatch.undo()
    own = CMo.SP.with_split(MD.model_frame(CMo.features(spark, SF001)), **CMo.K.FIXTURE_SPLIT)
    cols = ["loan_id", "label", "split", "loan_amnt", "purpose"]
    assert sorted(map(tuple, f.select(*cols).collect())) == sorted(map(tuple, own.select(*cols).collect()))
    assert spec == MD.infer_spec(own)


def test_spread_bounds_the_rows_of_a_part(spark):
    df = spark.range(1000).withColumnRenamed("id", "loan_id").coalesce(1)
    parts = MD.spread(df, rows=40).rdd.glom().map(len).collect()
    assert len(parts) == 25 and sum(parts) == 1000 and max(parts) < 100
