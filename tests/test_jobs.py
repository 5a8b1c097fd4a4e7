"""End-to-end jobs: flagship numbers, portfolio invariants, attribution additivity, stream = batch."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paths import SF001, SF01
from pdforge.plans import catalog as CAT

# FIXTURES.md §6 at sf0.01 (counts and decision splits)
EXPECTED = {
    "Very Low": (377, 377, 0, 0),
    "Low": (4955, 4315, 0, 640),
    "Medium": (3369, 2020, 0, 1349),
    "High": (1611, 0, 421, 1190),
    "Very High": (1283, 0, 0, 1283),
}


def test_flagship_all_years_matches_fixture_table(spark):
    rows = CAT.QUERIES["a9_portfolio_summary"](spark, SF01).collect()
    got = {r.risk_tier: (r.loan_count, r.approve_count, r.refer_count, r.deny_count) for r in rows}
    assert got == EXPECTED
    by = {r.risk_tier: r for r in rows}
    assert by["Very Low"].avg_pd == pytest.approx(0.0466, abs=1e-4)
    assert by["High"].actual_default_rate == pytest.approx(0.5965, abs=1e-4)


def test_portfolio_invariants(spark):
    rows = CAT.QUERIES["b6_portfolio_analysis"](spark, SF01).collect()
    assert sum(r.pct_of_portfolio for r in rows) == pytest.approx(100.0, abs=0.3)
    assert sum(r.pct_of_exposure for r in rows) == pytest.approx(100.0, abs=0.3)
    for r in rows:
        assert r.approve_count + r.refer_count + r.deny_count == r.loan_count
        if r.risk_tier == "Very High":
            assert r.deny_count == r.loan_count
        if r.risk_tier in ("High", "Very High"):
            assert r.approve_count == 0
    scored = CAT.test_scored(spark, SF01)
    assert scored.where((F.col("policy_decision") == "Approve") & (F.col("pd") >= 0.22)).count() == 0


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) >= {"risk_tier", "loan_count", "total_expected_loss"}


def test_every_query_has_unique_name():
    import __spark_entry__ as E
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 100


def test_cleaning_statistics_partition_independent(spark):
    from pdforge.operators import cleaning as CL
    from pdforge.sources.fixtures import raw_loans
    p = CL.impute_fixed(CL.prepare_for_imputation(raw_loans(spark, SF001)))
    a = CL.fit_statistics(p.repartition(1))
    b = CL.fit_statistics(p.repartition(7), finish_rows=5, grid=4, accuracy=50)
    assert a == b


def test_stream_equals_batch(spark):
    a = {tuple(r) for r in CAT.QUERIES["st1_stream_scoring"](spark, SF001).collect()}
    b = {tuple(r) for r in CAT.QUERIES["b4_application_scoring"](spark, SF001).collect()}
    assert a == b and len(a) > 0


def test_tree_attribution_additive(spark):
    from pyspark.ml.functions import vector_to_array
    from pdforge.operators import explain as EX
    from pdforge.operators import models as MD
    from pdforge.plans.catalog_models import _split, model_data

    f, spec = model_data(spark, SF001)
    m = MD.train_gbt(_split(f, "train"), _split(f, "val"), spec, {"n_estimators": 5, "max_depth": 3})
    rows = MD.fill_missing(_split(f, "test"), spec)
    prepared = m.model.stages[1].transform(m.model.stages[0].transform(rows))
    names = MD.numeric_inputs(spec) + [f"{c}_idx" for c in spec.categorical]
    gbt = m.model.stages[-1]
    attr = EX.tree_shap_frame(prepared, gbt, names).groupBy("loan_id").agg(F.sum("phi").alias("total"))
    p = vector_to_array("probability")[1]
    odds = gbt.transform(prepared).select("loan_id", F.log(p / (1 - p)).alias("log_odds"))
    joined = attr.join(odds, "loan_id").collect()
    assert joined
    diffs = np.array([r.total - r.log_odds for r in joined])
    assert np.abs(diffs).max() < 1e-6


def test_linear_attribution_additive(spark):
    att = CAT.QUERIES["t12_linear_attribution"](spark, SF001)
    from pdforge import constants as K
    s = CAT.scored(spark, SF001)
    from pdforge.operators.explain import LinearAttribution
    model = LinearAttribution.fit(s.where(F.col("split") == "train"), K.FORMULA_PD_COEFS, K.FORMULA_PD_INTERCEPT)
    tot = att.groupBy("loan_id").agg(F.sum("phi").alias("phi"))
    z = s.select("loan_id", (-F.log(1 / F.col("pd") - 1)).alias("z"))
    for r in tot.join(z, "loan_id").limit(50).collect():
        assert model.base_value() + r.phi == pytest.approx(r.z, abs=1e-9)


def test_sink_jobs_then_logistic_model(spark):
    """Sink jobs must leave the session usable for model pipelines (closures that capture it)."""
    CAT.QUERIES["b7_cleaning_job_sink"](spark, SF001).collect()
    assert CAT.QUERIES["t3_logistic_regression"](spark, SF001).count() > 0
