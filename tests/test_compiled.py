"""Compiled models against MLlib's own transform, attribution of fitted models, the parameter table, leakage over rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paths import SF001
from pdforge.operators import cleaning as CL
from pdforge.operators import compiled as CM
from pdforge.operators import explain as EX
from pdforge.operators import leakage as LK
from pdforge.operators import models as MD
from pdforge.session import scratch_path


def _frame(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=n), rng.normal(size=n)
    k = rng.choice(["car", "home", "debt", "it's"], n)
    y = ((a + 0.5 * b * (k == "car") + rng.normal(scale=0.7, size=n)) > 0.3).astype(int)
    rows = [(i, float(a[i]), None if i % 9 == 0 else float(b[i]), str(k[i]), 2.5, int(y[i]), int(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "loan_id long, a double, b double, k string, fixed double, target int, label int")


def _strange(spark):
    """Unseen and null levels, null inputs."""
    return spark.createDataFrame([(9001, 0.3, 0.1, "boat", 2.5), (9002, -0.4, None, None, 2.5), (9003, 0.0, 2.0, "car", 2.5)],
                                 "loan_id long, a double, b double, k string, fixed double")


SPEC = MD.ModelSpec(["a", "b", "fixed"], ["k"], ["b"], 5)


@pytest.fixture(scope="module")
def saved(spark):
    df = MD.fill_missing(_frame(spark), SPEC)
    w, total = MD.balanced_weights(df)
    out = {}
    for kind, pipe, rows in (("lr", MD.lr_pipeline(SPEC, 1.0, 100, total), w),
                             ("gbt", MD.gbt_pipeline(SPEC, {"n_estimators": 12, "max_depth": 4, "min_child_samples": 3}), MD.positive_weight(df)[0])):
        path = scratch_path(spark, f"test_{kind}")
        MD.save_model(MD.TrainedModel(kind, pipe.fit(rows), SPEC, 0.31, {}), path)
        out[kind] = path
    return out


@pytest.mark.parametrize("kind", ["lr", "gbt"])
def test_compiled_equals_transform(spark, saved, kind):
    m, c = MD.load_model(saved[kind]), CM.load_compiled(saved[kind])
    assert (c.name, c.threshold) == (kind, 0.31)
    rows = _frame(spark, 300, 8).drop("label", "target").unionByName(_strange(spark))
    own = {r.loan_id: r.pd for r in MD.predict_pd(m.model, MD.fill_missing(rows, SPEC)).collect()}
    got = {r.loan_id: r.pd for r in c.score(rows).collect()}
    assert len(got) == len(own) == 303 and max(abs(own[k] - got[k]) for k in own) < 1e-9
    plan = c.score(rows).select("loan_id", "pd")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_trees_compile_in_few_calls(spark, saved, monkeypatch):
    """Building a column a node takes a minute for 300 trees; the number of calls must not follow the trees."""
    m = MD.load_model(saved["gbt"])
    calls = []
    for name in ("when", "lit", "expr"):
        monkeypatch.setattr(CM.F, name, lambda *a, _f=getattr(CM.F, name): calls.append(1) or _f(*a))
    CM._tree_log_odds(m)
    assert len(calls) <= 10 < sum(len(t["left"]) for t in EX.tree_tables(m.model.stages[-1]))


def test_compiled_names_and_levels_of_any_characters(spark):
    levels = ["it's", "a\\b", "\u00fc`", ""]
    rows = [(i, float(i % 7), levels[i % 4], int((i % 4 == 1) or i % 7 > 4)) for i in range(200)]
    df = spark.createDataFrame(rows, ["loan_id", "x y", "k", "label"]).withColumn("weight", F.lit(1.0))
    spec = MD.ModelSpec(["x y"], ["k"], [], 4)
    fitted = MD.gbt_pipeline(spec, {"n_estimators": 5, "max_depth": 3, "min_child_samples": 2, "colsample_bytree": 1.0, "subsample": 1.0}).fit(df)
    own = {r.loan_id: r.pd for r in MD.predict_pd(fitted, df).collect()}
    got = CM.compile_model(MD.TrainedModel("t", fitted, spec, 0.5, {})).score(df).collect()
    assert max(abs(own[r.loan_id] - r.pd) for r in got) < 1e-9


def test_baseline_attribution_adds_up(spark, saved):
    c = CM.load_compiled(saved["lr"])
    rows = _frame(spark, 200, 5)
    a = CM.linear_attribution(c, _frame(spark))
    assert len(c.terms) == 3 + 1 + 5 and a.coefs.keys() == {t.feature for t in c.terms}
    total = F.aggregate(F.transform(a.contributions(), lambda s: s["phi"]), F.lit(a.base_value()), lambda x, y: x + y)
    assert rows.unionByName(_strange(spark), allowMissingColumns=True).where(F.abs(total - c.log_odds) >= 1e-9).count() == 0
    top = a.top_factors(rows, 5)
    assert top.groupBy("loan_id").count().where("count != 5").count() == 0
    long = EX.top_factors(a.explain(rows), 5)
    assert sorted(map(tuple, top.collect())) == sorted(map(tuple, long.collect()))


def test_trees_with_repeated_and_many_features(spark, saved, monkeypatch):
    m = MD.load_model(saved["gbt"])
    rows = MD.predict_pd(m.model, MD.fill_missing(_frame(spark, 60, 6), SPEC), keep=("features",))
    names = MD.numeric_inputs(SPEC) + ["k_idx"]

    def shap():
        return {(r.loan_id, r.feature): r.phi for r in EX.tree_shap_frame(rows, m.model.stages[-1], names).collect()}

    tables = shap()
    trees = EX.tree_tables(m.model.stages[-1])
    assert any(t["cats"][j] is not None for t in trees for j in range(len(t["left"])))
    monkeypatch.setattr(EX, "TABLE_FEATURES", 0)  # every leaf without a table
    x = np.array([list(r.features) for r in rows.orderBy("loan_id").collect()])
    phi = np.zeros((len(x), len(names)))
    for t in trees:
        EX.tree_shap(t, EX.leaf_tables(t), x, phi)
    ids = [r.loan_id for r in rows.select("loan_id").orderBy("loan_id").collect()]
    for i, loan in enumerate(ids):
        assert max(abs(tables[loan, n] - phi[i, k]) for k, n in enumerate(names)) < 1e-9
    for r in rows.collect():
        total = sum(tables[r.loan_id, n] for n in [*names, "__base__"])
        assert abs(total - np.log(r.pd / (1 - r.pd))) < 1e-6


def test_stream_with_a_model_equals_batch(spark, saved):
    from pdforge.operators import scoring as SC
    from pdforge.streaming.scoring_stream import score_application_files
    c = CM.load_compiled(saved["gbt"])
    apps = SC.scenario_frame(spark)
    template = {"inq_last_6mths": 0.0, "open_acc": 5.0, "total_acc": 9.0, "total_rev_hi_lim": 9000.0, "tot_cur_bal": 1e5, "tax_liens": 0.0,
                "pub_rec": 0.0, "inq_last_12m": 1.0, "num_accts_ever_120_pd": 0.0, "credit_history_months": 99.0, "a": 0.2, "b": 0.4,
                "fixed": 2.5, "k": "car", "mths_since_last_delinq": 999.0}
    cols = ["application_id", "probability_of_default", "policy_decision"]
    batch = SC.score_applications(apps, template, lambda rows: c.pd()).select(*cols)
    stream = score_application_files(spark, apps, template, pd_fn=lambda rows: c.pd()).select(*cols)
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, stream.collect())) and batch.count() == 4


def test_parameter_table(spark):
    path = scratch_path(spark, "params")
    assert MD.latest_params(spark, path, "gbt") is None
    assert MD.save_params(spark, path, "gbt", {"max_depth": 3}, 0.7) == 1
    assert MD.save_params(spark, path, "gbt", {"max_depth": 5}, 0.8) == 2
    assert MD.save_params(spark, path, "lr", {"C": 1.0}, 0.6) == 1
    assert MD.latest_params(spark, path, "gbt") == {"version": 2, "params": {"max_depth": 5}, "score": 0.8}
    draws = MD.gbt_param_draws(50)
    assert min(d["n_estimators"] for d in draws) >= 100 and max(d["max_depth"] for d in draws) <= 12


def test_linear_search_scores_every_draw(spark):
    best, res = MD.tune_logistic_regression(_frame(spark).drop("target"), SPEC, n_iter=3, folds=2)
    rows = res.collect()
    assert len(rows) == 3 and best["C"] == max(rows, key=lambda r: r.cv_auc).C and all(0.5 < r.cv_auc <= 1 for r in rows)


def test_draws_fitted_together_equal_single_fits(spark, monkeypatch):
    """Thirty draws of five folds as single fits run thousands of jobs; together they give the same scores."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pdforge.operators.splits import stratified_folds
    df = _frame(spark).drop("target")
    data, total = MD.balanced_weights(MD.fill_missing(df, SPEC))
    data = stratified_folds(data, 2, label="label", seed=MD.K.RANDOM_SEED)
    auc = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction", numBins=0)
    want = []
    for d in MD.lr_param_draws(3):
        fits = [(MD.lr_pipeline(SPEC, d["C"], d["max_iter"], total / 2).fit(data.where(F.col("fold") != k)), data.where(F.col("fold") == k)) for k in range(2)]
        want.append(sum(auc.evaluate(m.transform(rows)) for m, rows in fits) / 2)
    monkeypatch.setattr(MD.LogisticRegression, "fit", None)
    got = [r.cv_auc for r in MD.tune_logistic_regression(df, SPEC, n_iter=3, folds=2)[1].collect()]
    assert got == pytest.approx(want, abs=1e-3)


def test_leakage_depends_on_the_rows(spark):
    from pdforge.plans.catalog import raw
    table = raw(spark, SF001)
    full = {r.column: r for r in LK.leakage_by_class(table, CL.target_expr()).collect()}
    none = {r.column: r for r in LK.leakage_by_class(table.limit(0), CL.target_expr()).collect()}
    assert full.keys() == none.keys() and full
    assert all(r.n_values == 0 and r.gap is None for r in none.values()) and any(r.n_values > 0 for r in full.values())
    assert LK.leakage_by_class(table.select("loan_id", "loan_status"), CL.target_expr()).collect() == []


def test_rows_are_scored_without_interpreting_the_trees(spark, saved):
    """Hundreds of trees as one expression are interpreted for every row; frames and streams of rows walk the ensemble."""
    from pdforge.operators import scoring as SC
    c = CM.load_compiled(saved["gbt"])
    rows = _frame(spark, 300, 8).drop("label", "target").unionByName(_strange(spark)).withColumn("features", F.lit("own"))
    scored = c.score(rows)
    assert scored.columns == [*rows.columns, "pd"] and {r.features for r in scored.collect()} == {"own"}
    assert "aggregate(" not in scored._jdf.queryExecution().optimizedPlan().toString()
    assert scored.where(F.abs(F.col("pd") - c.pd()) > 1e-12).count() == 0
    template = {"inq_last_6mths": 0.0, "open_acc": 5.0, "total_acc": 9.0, "total_rev_hi_lim": 9000.0, "tot_cur_bal": 1e5, "tax_liens": 0.0,
                "pub_rec": 0.0, "inq_last_12m": 1.0, "num_accts_ever_120_pd": 0.0, "credit_history_months": 99.0, "a": 0.2, "b": 0.4,
                "fixed": 2.5, "k": "car", "mths_since_last_delinq": 999.0}
    cols = ["application_id", "probability_of_default", "policy_decision"]
    one, two = (SC.score_applications(SC.scenario_frame(spark), template, f).select(*cols).collect() for f in (c.score, lambda rows: c.pd()))
    assert sorted(map(tuple, one)) == sorted(map(tuple, two)) and len(one) == 4
