"""Risk tier, knock-out policy and expected-loss expressions.

Everything is a Column expression evaluated per row inside codegen: no UDF,
no per-row Python loop, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pdforge import constants as K
from pdforge.functions.encoding import null_if_nan, safe_value


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp_pd(pd_col) -> Column:
    """PD clamped to [0, 1]; NaN -> 1.0 as in the original clamp; null stays null."""
    p = _c(pd_col).cast("double")
    return F.when(p.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def _tier_field(p: Column, idx: int) -> Column:
    expr = F.when(p.isNull(), F.lit(None).cast("string"))
    for row in K.RISK_TIERS:
        bound, value = row[0], row[idx]
        expr = expr.otherwise(F.lit(value)) if bound is None else expr.when(p < bound, F.lit(value))
    return expr


def risk_tier(pd_col) -> Column:
    return _tier_field(clamp_pd(pd_col), 1)


def tier_rank(tier_col) -> Column:
    """0 for Very Low ... 4 for Very High (sort key for tier reports)."""
    pairs = []
    for i, t in enumerate(K.TIER_ORDER):
        pairs += [F.lit(t), F.lit(i)]
    return F.try_element_at(F.create_map(*pairs), _c(tier_col))


def risk_bucket(pd_col) -> Column:
    """Struct with clamped (unrounded) PD, tier, grade, rate range, description, action."""
    p = clamp_pd(pd_col)
    return F.struct(
        p.alias("probability_of_default"),
        _tier_field(p, 1).alias("risk_tier"),
        _tier_field(p, 2).alias("credit_grade"),
        _tier_field(p, 3).alias("recommended_interest_rate"),
        _tier_field(p, 4).alias("risk_description"),
        _tier_field(p, 5).alias("recommended_action"),
    )


def loan_pct_income_policy(loan_amnt, annual_inc) -> Column:
    """loan / max(1, income) * 100 in double; unknown income counts as 1."""
    inc = F.coalesce(F.greatest(null_if_nan(annual_inc), F.lit(1.0)), F.lit(1.0))
    return null_if_nan(loan_amnt) / inc * 100.0


def policy_inputs(dti="dti", inq="inq_last_6mths", delinq="delinq_2yrs",
                  annual_inc="annual_inc", loan_amnt="loan_amnt") -> dict[str, Column]:
    """Policy inputs with the scoring defaults for null / NaN values."""
    dfl = K.POLICY_INPUT_DEFAULTS
    return {
        "dti": safe_value(_c(dti), dfl["dti"]),
        "inq_last_6mths": safe_value(_c(inq), dfl["inq_last_6mths"]),
        "delinq_2yrs": safe_value(_c(delinq), dfl["delinq_2yrs"]),
        "annual_inc": safe_value(_c(annual_inc), dfl["annual_inc"]),
        "loan_amnt": safe_value(_c(loan_amnt), dfl["loan_amnt"]),
    }


def leverage_reason(pct: Column) -> Column:
    pct_txt = F.format_string("%.1f", pct)
    pre, post = K.REASON_LEVERAGE_FMT.split("{pct}")
    return F.concat(F.lit(pre), pct_txt, F.lit(post))


def triggered_rules(pd_col, dti: Column, inq: Column, delinq: Column, pct: Column) -> Column:
    """Array of rule texts, in rule order; empty when nothing trips."""
    p = null_if_nan(pd_col)
    return F.array_compact(F.array(
        F.when(p >= K.POLICY_PD_DENY, F.lit(K.REASON_PD)),
        F.when(dti > K.POLICY_MAX_DTI, F.lit(K.REASON_DTI)),
        F.when(inq > K.POLICY_MAX_INQUIRIES, F.lit(K.REASON_INQUIRIES)),
        F.when(delinq > K.POLICY_MAX_DELINQUENCIES, F.lit(K.REASON_DELINQUENCIES)),
        F.when(pct > K.POLICY_MAX_LOAN_PCT_INCOME, leverage_reason(pct)),
    ))


def rule_codes(pd_col, dti: Column, inq: Column, delinq: Column, pct: Column) -> Column:
    """Short codes of the tripped rules joined by '|' (compact form for reports)."""
    p = null_if_nan(pd_col)
    return F.concat_ws("|",
                       F.when(p >= K.POLICY_PD_DENY, F.lit("PD")),
                       F.when(dti > K.POLICY_MAX_DTI, F.lit("DTI")),
                       F.when(inq > K.POLICY_MAX_INQUIRIES, F.lit("INQ")),
                       F.when(delinq > K.POLICY_MAX_DELINQUENCIES, F.lit("DELINQ")),
                       F.when(pct > K.POLICY_MAX_LOAN_PCT_INCOME, F.lit("LTI")))


def any_rule(pd_col, dti: Column, inq: Column, delinq: Column, pct: Column) -> Column:
    """True when any knock-out rule trips (same tests as ``triggered_rules``, no texts built)."""
    p = null_if_nan(pd_col)
    return F.coalesce(p >= K.POLICY_PD_DENY, F.lit(False)) | (dti > K.POLICY_MAX_DTI) | \
        (inq > K.POLICY_MAX_INQUIRIES) | (delinq > K.POLICY_MAX_DELINQUENCIES) | \
        F.coalesce(pct > K.POLICY_MAX_LOAN_PCT_INCOME, F.lit(False))


def decision_from_flag(denied: Column, pd_col) -> Column:
    p = null_if_nan(pd_col)
    return (F.when(denied, F.lit("Deny"))
            .when(p >= K.POLICY_PD_REFER, F.lit("Refer"))
            .otherwise(F.lit("Approve")))


def decision_from_rules(rules: Column, pd_col) -> Column:
    p = null_if_nan(pd_col)
    return (F.when(F.size(rules) > 0, F.lit("Deny"))
            .when(p >= K.POLICY_PD_REFER, F.lit("Refer"))
            .otherwise(F.lit("Approve")))


def policy_decision(pd_col, **inputs) -> Column:
    """Full decision record: decision, rules, adverse reasons, comments, metrics."""
    x = policy_inputs(**inputs)
    pct = loan_pct_income_policy(x["loan_amnt"], x["annual_inc"])
    rules = triggered_rules(pd_col, x["dti"], x["inq_last_6mths"], x["delinq_2yrs"], pct)
    decision = decision_from_rules(rules, pd_col)
    return F.struct(
        decision.alias("decision"),
        rules.alias("triggered_rules"),
        F.when(decision == "Deny", rules).otherwise(F.array().cast("array<string>"))
        .alias("adverse_action_reasons"),
        F.when(decision == "Deny", F.lit(K.COMMENT_DENY))
        .when(decision == "Refer", F.lit(K.COMMENT_REFER))
        .otherwise(F.lit(K.COMMENT_APPROVE)).alias("comments"),
        F.struct(
            x["dti"].alias("dti"),
            x["inq_last_6mths"].cast("int").alias("inq_last_6mths"),
            x["delinq_2yrs"].cast("int").alias("delinq_2yrs"),
            F.round(pct, 1).alias("loan_to_income_pct"),
        ).alias("policy_metrics"),
    )


def pd_rounded(pd_col) -> Column:
    return F.round(_c(pd_col).cast("double"), 4)


def exposure_at_default(loan_amnt="loan_amnt") -> Column:
    return F.coalesce(_c(loan_amnt).cast("double"), F.lit(0.0))


def expected_loss(pd4, ead: Column, lgd: float = K.DEFAULT_LGD) -> Column:
    """EL = PD (4 places) x LGD x EAD."""
    return _c(pd4) * F.lit(float(lgd)) * ead


def formula_pd(delinq="delinq_2yrs", dti="dti", pct="loan_pct_of_income") -> Column:
    """Closed-form logistic PD used for exact, model-free checks of everything downstream."""
    z = (F.lit(K.FORMULA_PD_INTERCEPT)
         + F.lit(K.FORMULA_PD_COEFS["delinq_2yrs"]) * _c(delinq).cast("double")
         + F.lit(K.FORMULA_PD_COEFS["dti"]) * _c(dti).cast("double")
         + F.lit(K.FORMULA_PD_COEFS["loan_pct_of_income"]) * _c(pct).cast("double"))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
