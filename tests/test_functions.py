"""Edge cases of the scalar expressions (null / NaN rules, boundaries)."""

import math

import pytest
from pyspark.sql import functions as F

from pdforge import constants as K
from pdforge.functions import features as FE
from pdforge.functions import parsing
from pdforge.functions import risk as R
from pdforge.functions.encoding import ordinal_code


def one(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_parse_term(spark):
    assert one(spark, [(" 36 months",), (" 60 months",), (None,)], "t string", parsing.parse_term("t")) == [36, 60, None]


def test_parse_emp_length(spark):
    vals = ["< 1 year", "1 year", "2 years", "9 years", "10+ years", "n/a", None]
    got = one(spark, [(v,) for v in vals], "e string", parsing.parse_emp_length("e"))
    assert got == [0, 1, 2, 9, 10, -1, -1]


def test_dates_and_history(spark):
    rows = [("Dec-2018", "Jan-2010"), ("Xyz-2018", "Jan-2010"), (None, "Jan-2010")]
    df = spark.createDataFrame(rows, "i string, e string")
    out = df.select(parsing.issue_year("i"), parsing.issue_month("i"),
                    parsing.credit_history_months("i", "e")).collect()
    assert tuple(out[0]) == (2018, 12, 8 * 12 + 11)
    assert tuple(out[1]) == (2018, 0, 8 * 12 - 1)  # unknown month -> 0
    assert out[2][0] is None and out[2][1] == 0 and out[2][2] is None


def test_ordinal_codes_default_zero(spark):
    got = one(spark, [("OWN",), ("RENT",), ("ANY",), ("weird",), (None,)], "h string",
              ordinal_code("h", K.HOME_OWNERSHIP_CODES))
    assert got == [3, 1, 0, 0, 0]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(100.0, None), (100.0, 0.5), (None, 10.0)], "annual_inc double, loan_amnt double")
    got = [r[0] for r in df.select(FE.income_to_loan()).collect()]
    assert got[0] is None and got[1] == pytest.approx(100.0) and got[2] is None


def test_credit_age_groups(spark):
    got = one(spark, [(59,), (60,), (119,), (120,), (179,), (180,), (None,)], "credit_history_months int",
              FE.credit_age_group())
    assert got == [0, 1, 1, 2, 2, 3, 3]


def test_tier_boundaries(spark):
    pds = [0.0499, 0.05, 0.1199, 0.12, 0.2199, 0.22, 0.3499, 0.35, float("nan"), -1.0, 2.0, None]
    got = one(spark, [(p,) for p in pds], "pd double", R.risk_tier("pd"))
    assert got == ["Very Low", "Low", "Low", "Medium", "Medium", "High", "High", "Very High",
                   "Very High", "Very Low", "Very High", None]


def _decide(spark, rows):
    df = spark.createDataFrame(rows, "pd double, dti double, inq_last_6mths double, delinq_2yrs double, "
                                     "annual_inc double, loan_amnt double")
    return df.select(R.policy_decision(F.col("pd")).alias("d")).collect()


def test_policy_boundaries(spark):
    base = (0.10, 10.0, 0.0, 0.0, 100000.0, 10000.0)
    cases = {
        base: "Approve",
        (0.22, 10.0, 0.0, 0.0, 100000.0, 10000.0): "Refer",
        (0.35, 10.0, 0.0, 0.0, 100000.0, 10000.0): "Deny",
        (0.10, 50.0, 0.0, 0.0, 100000.0, 10000.0): "Approve",
        (0.10, 50.01, 0.0, 0.0, 100000.0, 10000.0): "Deny",
        (0.10, 10.0, 5.0, 0.0, 100000.0, 10000.0): "Approve",
        (0.10, 10.0, 6.0, 0.0, 100000.0, 10000.0): "Deny",
        (0.10, 10.0, 0.0, 3.0, 100000.0, 10000.0): "Approve",
        (0.10, 10.0, 0.0, 4.0, 100000.0, 10000.0): "Deny",
        (0.10, 10.0, 0.0, 0.0, 100000.0, 45000.0): "Approve",
        (0.10, 10.0, 0.0, 0.0, 100000.0, 45001.0): "Deny",
    }
    out = _decide(spark, list(cases))
    assert [r["d"]["decision"] for r in out] == list(cases.values())


def test_policy_nan_rules(spark):
    nan = float("nan")
    out = _decide(spark, [(nan, nan, nan, nan, 100000.0, 10000.0), (0.1, 10.0, 0.0, 0.0, nan, 10000.0),
                          (0.1, 10.0, 0.0, 0.0, None, 10000.0)])
    # NaN PD / DTI / counts trip nothing (Python comparison semantics); unknown income counts as 1
    assert out[0]["d"]["decision"] == "Approve"
    assert out[1]["d"]["decision"] == "Deny" and out[2]["d"]["decision"] == "Deny"
    assert out[1]["d"]["policy_metrics"]["loan_to_income_pct"] == pytest.approx(1000000.0)


def test_deny_reasons_only_on_deny(spark):
    out = _decide(spark, [(0.30, 10.0, 0.0, 0.0, 100000.0, 10000.0), (0.5, 60.0, 6.0, 4.0, 10000.0, 9000.0)])
    assert out[0]["d"]["adverse_action_reasons"] == [] and out[0]["d"]["decision"] == "Refer"
    reasons = out[1]["d"]["adverse_action_reasons"]
    assert reasons[:4] == [K.REASON_PD, K.REASON_DTI, K.REASON_INQUIRIES, K.REASON_DELINQUENCIES]
    assert reasons[4] == K.REASON_LEVERAGE_FMT.format(pct="90.0")


def test_scenario_leverage(spark):
    rows = [(0.01, dti, 0.0, float(dq), inc, amt) for (_, amt, _, inc, dti, _, _, dq) in K.SCENARIOS]
    out = _decide(spark, rows)
    pcts = [r["d"]["policy_metrics"]["loan_to_income_pct"] for r in out]
    assert pcts == [12.0, 66.7, 54.5, 20.8]
    assert [r["d"]["decision"] for r in out] == ["Approve", "Deny", "Deny", "Deny"]


def test_formula_pd_matches_python(spark):
    df = spark.createDataFrame([(2.0, 20.0, 30.0)], "delinq_2yrs double, dti double, loan_pct_of_income double")
    got = df.select(R.formula_pd()).first()[0]
    z = -3.2 + 0.45 * 2 + 0.02 * 20 + 0.008 * 30
    assert got == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-15)
