"""Queries for scalar functions, windows, curve metrics, linear attribution
and the scoring / portfolio jobs (continuation of ``catalog``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pdforge import constants as K
from pdforge.functions import features as FE
from pdforge.functions import parsing
from pdforge.functions import risk as R
from pdforge.functions.encoding import ordinal_code
from pdforge.operators import cleaning as CL
from pdforge.operators import explain as EX
from pdforge.operators import metrics as M
from pdforge.operators import portfolio as PF
from pdforge.operators import scoring as SC
from pdforge.operators import splits as SP
from pdforge.plans import oracle as O
from pdforge.plans.catalog import (SPLIT_SQL, TIER_RANK_SQL, W, _portfolio_sql, cleaned, features, labelled,
                                   prepared_columns, score_features,
                                   prepared, raw, register, resolved, scored, scored_split, test_scored)

# ---------------------------------------------------------------------------
# Parsing, fills, caps, maps
# ---------------------------------------------------------------------------
@register("x1_term", W("raw_loans") + "SELECT loan_id, CAST(replace(trim(term), ' months', '') AS SMALLINT) AS term FROM raw_loans")
def x1_term(spark, d):
    return raw(spark, d).select("loan_id", parsing.parse_term("term").alias("term"))


EMP_SQL = ("CAST(coalesce(CAST(trim(regexp_replace(regexp_replace(replace(CASE WHEN emp_length = 'n/a' THEN NULL "
           "ELSE emp_length END, '< 1 year', '0'), '\\+ years?', ''), ' years?', '')) AS FLOAT), -1.0) AS TINYINT)")


@register("x2_emp_length", W("raw_loans") + f"SELECT loan_id, emp_length, {EMP_SQL} AS emp_length_num FROM raw_loans")
def x2_emp_length(spark, d):
    return raw(spark, d).select("loan_id", "emp_length", parsing.parse_emp_length("emp_length").alias("emp_length_num"))


@register("x3_issue_date", W("raw_loans") + f"""SELECT loan_id, {O._year('issue_d')} AS issue_year,
  CAST({O._month('issue_d')} AS TINYINT) AS issue_month FROM raw_loans""")
def x3_issue_date(spark, d):
    return raw(spark, d).select("loan_id", parsing.issue_year().alias("issue_year"),
                                parsing.issue_month().alias("issue_month"))


@register("x4_credit_history_months", W("raw_loans") + f"""SELECT loan_id,
  CAST((CAST({O._year('issue_d')} AS INTEGER) - CAST({O._year('earliest_cr_line')} AS INTEGER)) * 12
       + ({O._month('issue_d')} - {O._month('earliest_cr_line')}) AS SMALLINT) AS credit_history_months FROM raw_loans""")
def x4_credit_history_months(spark, d):
    return raw(spark, d).select("loan_id", parsing.credit_history_months().alias("credit_history_months"))


@register("x5_never_happened_fill", W("prepared") + "SELECT loan_id, mths_since_last_delinq, mths_since_last_record FROM prepared")
def x5_never_happened_fill(spark, d):
    return prepared(spark, d).select("loan_id", "mths_since_last_delinq", "mths_since_last_record")


@register("x6_zero_fill", W("prepared") + "SELECT loan_id, tax_liens FROM prepared")
def x6_zero_fill(spark, d):
    return prepared(spark, d).select("loan_id", "tax_liens")


X7_SQL = W("cleaned") + "SELECT p.loan_id, " + ", ".join(
    f"coalesce(p.{c}, m.{c}) AS {c}" for c in O.MEDIAN_COLS) + " FROM prepared p, med m"


@register("x7_median_fill", X7_SQL)
def x7_median_fill(spark, d):
    p = prepared_columns(spark, d, ["loan_id", *O.MEDIAN_COLS])
    stats = CL.fit_statistics(p, cap_cols=[])
    return CL.impute_medians(p, stats).select("loan_id", *O.MEDIAN_COLS)


X8_SQL = W("cleaned") + "SELECT p.loan_id, " + ", ".join(
    f"CASE WHEN coalesce(p.{c}, m.{c}) > k.{c} THEN k.{c} ELSE coalesce(p.{c}, m.{c}) END AS {c}"
    for c in O.CAP_COLS) + " FROM prepared p, med m, cap k"


@register("x8_cap_outliers", X8_SQL)
def x8_cap_outliers(spark, d):
    p = prepared_columns(spark, d, ["loan_id", *O.CAP_COLS])
    stats = CL.fit_statistics(p)
    return CL.cap_outliers(CL.impute_medians(p, stats), stats).select("loan_id", *O.CAP_COLS)


X9_SQL = W("raw_loans") + "SELECT loan_id, " + ", ".join(
    f"{O._codes(c, codes)} AS {c}_enc" for c, codes in K.ENCODED_CATEGORICALS.items()) + " FROM raw_loans"


@register("x9_ordinal_codes", X9_SQL)
def x9_ordinal_codes(spark, d):
    return raw(spark, d).select("loan_id", *[ordinal_code(c, codes).alias(f"{c}_enc")
                                             for c, codes in K.ENCODED_CATEGORICALS.items()])


@register("x10_categories", W("cleaned") + "SELECT loan_id, purpose, addr_state FROM cleaned")
def x10_categories(spark, d):
    return resolved(spark, d).select("loan_id", "purpose", "addr_state")


# ---------------------------------------------------------------------------
# Features (one query each)
# ---------------------------------------------------------------------------
FEATURE_IDS = {"income_to_loan": 11, "loan_pct_of_income": 12, "monthly_debt_dollar": 13,
               "credit_util_x_balance": 14, "delinq_score": 15, "inquiry_score": 16, "open_acct_ratio": 17,
               "balance_vs_income": 18, "credit_age_group": 19, "revol_bal_vs_limit": 20}

# what the ten features read
FEATURE_READS = ["loan_amnt", "annual_inc", "dti", "revol_bal", "revol_util", "delinq_2yrs", "pub_rec",
                 "num_accts_ever_120_pd", "inq_last_6mths", "inq_last_12m", "open_acc", "total_acc", "tot_cur_bal",
                 "credit_history_months", "total_rev_hi_lim"]


def _feature_query(name):
    def q(spark, d):
        if name == "credit_age_group":  # reads no fitted column
            return resolved(spark, d).select("loan_id", FE.credit_age_group().alias(name))
        return features(spark, d, ["loan_id", *FEATURE_READS]).select("loan_id", name)
    q.__name__ = f"x{FEATURE_IDS[name]}_{name}"
    return q


for _n, _i in FEATURE_IDS.items():
    register(f"x{_i}_{_n}", W("features") + f"SELECT loan_id, {_n} FROM features")(_feature_query(_n))


# ---------------------------------------------------------------------------
# Risk functions
# ---------------------------------------------------------------------------
@register("x21_clamp_pd", W("scored") + """SELECT loan_id,
  greatest(0.0, least(1.0, probability_of_default * 2 - 0.5)) AS clamped FROM scored""")
def x21_clamp_pd(spark, d):
    return scored(spark, d).select("loan_id", R.clamp_pd(F.col("probability_of_default") * 2 - 0.5).alias("clamped"))


@register("x22_risk_bucket", W("scored") + f"""SELECT loan_id, {O._tier(O.CLAMP, 1)} AS risk_tier,
  {O._tier(O.CLAMP, 2)} AS credit_grade, {O._tier(O.CLAMP, 3)} AS recommended_interest_rate,
  {O._tier(O.CLAMP, 4)} AS risk_description, {O._tier(O.CLAMP, 5)} AS recommended_action FROM scored""")
def x22_risk_bucket(spark, d):
    b = scored(spark, d).select("loan_id", R.risk_bucket("pd").alias("b"))
    return b.select("loan_id", "b.risk_tier", "b.credit_grade", "b.recommended_interest_rate",
                    "b.risk_description", "b.recommended_action")


RULES_SQL = f"""concat_ws('|',
    CASE WHEN pd >= 0.35 THEN 'PD' END,
    CASE WHEN coalesce(CAST(dti AS DOUBLE), 0.0) > 50.0 THEN 'DTI' END,
    CASE WHEN coalesce(inq_last_6mths, 0.0) > 5 THEN 'INQ' END,
    CASE WHEN coalesce(delinq_2yrs, 0.0) > 3 THEN 'DELINQ' END,
    CASE WHEN {O.PCT_SQL} > 45.0 THEN 'LTI' END)"""
N_RULES_SQL = f"""((CASE WHEN pd >= 0.35 THEN 1 ELSE 0 END) + (CASE WHEN coalesce(CAST(dti AS DOUBLE), 0.0) > 50.0 THEN 1 ELSE 0 END)
  + (CASE WHEN coalesce(inq_last_6mths, 0.0) > 5 THEN 1 ELSE 0 END) + (CASE WHEN coalesce(delinq_2yrs, 0.0) > 3 THEN 1 ELSE 0 END)
  + (CASE WHEN {O.PCT_SQL} > 45.0 THEN 1 ELSE 0 END))"""


def _policy_cols(df: DataFrame) -> DataFrame:
    x = R.policy_inputs()
    pct = R.loan_pct_income_policy(x["loan_amnt"], x["annual_inc"])
    rules = R.triggered_rules(F.col("pd"), x["dti"], x["inq_last_6mths"], x["delinq_2yrs"], pct)
    return df.select("*", rules.alias("_rules"),
                     R.rule_codes(F.col("pd"), x["dti"], x["inq_last_6mths"], x["delinq_2yrs"], pct).alias("rule_codes"),
                     F.round(pct, 1).alias("loan_to_income_pct"),
                     R.policy_decision(F.col("pd")).alias("_decision"))


@register("x23_policy_rules", W("scored") + f"""SELECT loan_id, CAST({N_RULES_SQL} AS INTEGER) AS n_rules,
  {RULES_SQL} AS rule_codes, round({O.PCT_SQL}, 1) AS loan_to_income_pct FROM scored""")
def x23_policy_rules(spark, d):
    p = _policy_cols(scored(spark, d))
    return p.select("loan_id", F.size("_rules").alias("n_rules"), "rule_codes", "loan_to_income_pct")


@register("x24_policy_decision", W("scored") + f"""SELECT loan_id, policy_decision AS decision,
  CASE policy_decision WHEN 'Deny' THEN '{K.COMMENT_DENY}' WHEN 'Refer' THEN '{K.COMMENT_REFER}'
       ELSE '{K.COMMENT_APPROVE}' END AS comments,
  CAST(CASE WHEN policy_decision = 'Deny' THEN {N_RULES_SQL} ELSE 0 END AS INTEGER) AS n_adverse FROM scored""")
def x24_policy_decision(spark, d):
    p = _policy_cols(scored(spark, d))
    return p.select("loan_id", F.col("_decision.decision").alias("decision"), F.col("_decision.comments").alias("comments"),
                    F.size("_decision.adverse_action_reasons").alias("n_adverse"))


@register("x25_expected_loss", W("scored") + "SELECT loan_id, ead, expected_loss FROM losses")
def x25_expected_loss(spark, d):
    return PF.with_loss_columns(scored(spark, d)).select("loan_id", "ead", "expected_loss")


# ---------------------------------------------------------------------------
# windows, sorts, sets
# ---------------------------------------------------------------------------
#: Places to which thresholds are shown: exp() of the two engines may differ in a PD's last bit. Curves group the raw PD.
THRESHOLD_PLACES = 10


def shown(column: str = "score"):
    return F.round(column, THRESHOLD_PLACES)


def curve_ctes(where: str = "split = 'test'", sfx: str = "", score: str = "pd") -> str:
    frame = "ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return f""", g{sfx} AS (SELECT CAST({score} AS DOUBLE) AS score,
      count(*) FILTER (WHERE target = 1) AS pos, count(*) FILTER (WHERE target <> 1) AS neg
    FROM scored WHERE {where} AND {score} IS NOT NULL AND target IS NOT NULL GROUP BY 1),
c{sfx} AS (SELECT score, pos, neg, CAST(sum(pos) OVER ({frame}) AS BIGINT) AS tp,
      CAST(sum(neg) OVER ({frame}) AS BIGINT) AS fp,
      CAST(sum(pos) OVER () AS BIGINT) AS P, CAST(sum(neg) OVER () AS BIGINT) AS N FROM g{sfx}),
cb{sfx} AS (SELECT *, tp - pos AS tp_before, fp - neg AS fp_before, tp * N - fp * P AS j FROM c{sfx})
"""


@register("w1_cumulative_counts", W("scored") + curve_ctes()
          + f"SELECT round(score, {THRESHOLD_PLACES}) AS score, pos, neg, tp, fp FROM cb")
def w1_cumulative_counts(spark, d):
    return M.curve_table(labelled(test_scored(spark, d)), "label", "score") \
        .select(shown().alias("score"), "pos", "neg", "tp", "fp")


@register("w2_ordered_tiers", W("scored") + f"""SELECT risk_tier, {TIER_RANK_SQL} AS tier_rank, count(loan_amnt) AS loan_count
FROM scored GROUP BY risk_tier""")
def w2_ordered_tiers(spark, d):
    s = PF.portfolio_summary(scored(spark, d))
    return s.select("risk_tier", R.tier_rank("risk_tier").alias("tier_rank"), "loan_count").orderBy("tier_rank")


@register("w3_sort_by_year_target", W("features") + "SELECT issue_year, target, count(*) AS n FROM features GROUP BY 1, 2")
def w3_sort_by_year_target(spark, d):
    return (resolved(spark, d).groupBy("issue_year", "target").agg(F.count(F.lit(1)).alias("n"))
            .orderBy("issue_year", "target"))


@register("w7_union_train_val", W("features") + f"""SELECT loan_id, split FROM (SELECT loan_id, {SPLIT_SQL} AS split
FROM features WHERE target IS NOT NULL) WHERE split IN ('train', 'val')""")
def w7_union_train_val(spark, d):
    f = resolved(spark, d)
    train = SP.with_split(f.where(SP.split_predicate("train", **K.FIXTURE_SPLIT)), **K.FIXTURE_SPLIT).select("loan_id", "split")
    val = SP.with_split(f.where(SP.split_predicate("val", **K.FIXTURE_SPLIT)), **K.FIXTURE_SPLIT).select("loan_id", "split")
    return train.unionByName(val)


# ---------------------------------------------------------------------------
# Curve metrics on the test cohort (label = target, score = PD as computed)
# ---------------------------------------------------------------------------
@register("m1_roc_curve", W("scored") + curve_ctes() + f"""SELECT round(score, {THRESHOLD_PLACES}) AS threshold, tp, fp,
  tp / P AS tpr, fp / N AS fpr FROM cb
UNION ALL SELECT 'inf'::DOUBLE, 0, 0, 0.0, 0.0""")
def m1_roc_curve(spark, d):
    return M.roc_points(M.curve_table(labelled(test_scored(spark, d)), "label", "score")) \
        .withColumn("threshold", shown("threshold"))


@register("m2_pr_curve", W("scored") + curve_ctes() + f"""SELECT round(score, {THRESHOLD_PLACES}) AS threshold,
  tp / (tp + fp) AS precision, tp / P AS recall FROM cb
UNION ALL SELECT NULL::DOUBLE, 1.0, 0.0""")
def m2_pr_curve(spark, d):
    return M.pr_points(M.curve_table(labelled(test_scored(spark, d)), "label", "score")) \
        .withColumn("threshold", shown("threshold"))


def metrics_sql(name: str = "mt", sfx: str = "") -> str:
    return f""", {name} AS (SELECT
  CAST(sum(neg * (2 * tp_before + pos)) AS DOUBLE) / (2.0 * CAST(max(P) AS DOUBLE) * CAST(max(N) AS DOUBLE)) AS roc_auc,
  CAST(sum(CASE WHEN pos > 0 THEN CAST((pos / P) * (tp / (tp + fp)
       + CASE WHEN tp_before + fp_before = 0 THEN 1.0 ELSE tp_before / (tp_before + fp_before) END) / 2.0
       AS DECIMAL(38,12)) END) AS DOUBLE) AS pr_auc,
  CAST(max(abs(j)) AS DOUBLE) / (CAST(max(P) AS DOUBLE) * max(N)) * 100.0 AS ks_stat_pct,
  CASE WHEN max(j) > 0 THEN (SELECT score FROM cb{sfx} ORDER BY j DESC, score DESC LIMIT 1) ELSE 'inf'::DOUBLE END
    AS youden_threshold,
  CAST(greatest(max(j), 0) AS DOUBLE) / (CAST(max(P) AS DOUBLE) * max(N)) AS youden_j
FROM cb{sfx})
"""


METRICS_SQL = metrics_sql()


@register("m3_roc_auc", W("scored") + curve_ctes() + METRICS_SQL + "SELECT roc_auc FROM mt")
def m3_roc_auc(spark, d):
    return M.curve_metrics(M.curve_table(labelled(test_scored(spark, d)), "label", "score")).select("roc_auc")


@register("m4_pr_auc", W("scored") + curve_ctes() + METRICS_SQL + "SELECT pr_auc FROM mt")
def m4_pr_auc(spark, d):
    return M.curve_metrics(M.curve_table(labelled(test_scored(spark, d)), "label", "score")).select("pr_auc")


@register("m5_ks_statistic", W("scored") + curve_ctes() + METRICS_SQL + "SELECT ks_stat_pct FROM mt")
def m5_ks_statistic(spark, d):
    return M.curve_metrics(M.curve_table(labelled(test_scored(spark, d)), "label", "score")).select("ks_stat_pct")


@register("m6_gini", W("scored") + curve_ctes() + METRICS_SQL + "SELECT 2.0 * roc_auc - 1.0 AS gini FROM mt")
def m6_gini(spark, d):
    return M.curve_metrics(M.curve_table(labelled(test_scored(spark, d)), "label", "score")).select("gini")


@register("m7_youden_threshold", W("scored") + curve_ctes() + METRICS_SQL
          + f"SELECT round(youden_threshold, {THRESHOLD_PLACES}) AS youden_threshold, youden_j FROM mt")
def m7_youden_threshold(spark, d):
    return M.curve_metrics(M.curve_table(labelled(test_scored(spark, d)), "label", "score")) \
        .select(shown("youden_threshold").alias("youden_threshold"), "youden_j")


def confusion_sql(t: str, where: str = "split = 'test'", score: str = "pd", sfx: str = "") -> str:
    return f""", cm{sfx} AS (SELECT count(*) FILTER (WHERE {score} >= {t} AND target = 1) AS tp,
  count(*) FILTER (WHERE {score} >= {t} AND target <> 1) AS fp,
  count(*) FILTER (WHERE NOT ({score} >= {t}) AND target <> 1) AS tn,
  count(*) FILTER (WHERE NOT ({score} >= {t}) AND target = 1) AS fn
  FROM scored WHERE {where} AND target IS NOT NULL),
cm2{sfx} AS (SELECT *, (tp + tn) / (tp + fp + tn + fn) AS accuracy,
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM cm{sfx}),
cm3{sfx} AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
  FROM cm2{sfx})
"""


@register("m8_confusion", W("scored") + confusion_sql("0.22") + "SELECT * FROM cm3")
def m8_confusion(spark, d):
    return M.confusion(labelled(test_scored(spark, d)), 0.22, "label", "score")


M9_SQL = (W("scored") + curve_ctes("split = 'val'", "_v") + metrics_sql("vt", "_v")
          + confusion_sql("(SELECT youden_threshold FROM vt)") + curve_ctes() + METRICS_SQL
          + """SELECT round(roc_auc, 4) AS roc_auc, round(pr_auc, 4) AS pr_auc,
  round(2.0 * roc_auc - 1.0, 4) AS gini, round(ks_stat_pct, 2) AS ks_stat_pct, round(accuracy, 4) AS accuracy,
  round(precision, 4) AS default_precision, round(recall, 4) AS default_recall, round(f1, 4) AS default_f1,
  round((SELECT youden_threshold FROM vt), 4) AS threshold FROM mt, cm3""")


@register("m9_metric_bundle", M9_SQL)
def m9_metric_bundle(spark, d):
    scores = model_scores(spark, d, {"formula": F.col("pd")})
    return M.evaluate_models(scores).select(*M.BUNDLE)


def model_scores(spark, d, models: dict) -> DataFrame:
    """(model, split, label, score) of the validation and test rows: each row is read and cleaned once for all models."""
    kept = SP.split_predicate("val", **K.FIXTURE_SPLIT) | SP.split_predicate("test", **K.FIXTURE_SPLIT)
    rows = SC.with_formula_pd(SP.with_split(score_features(spark, d).where(kept), **K.FIXTURE_SPLIT))
    each = [F.struct(F.lit(name).alias("model"), score.cast("double").alias("score")) for name, score in models.items()]
    return rows.select("split", F.col("target").cast("int").alias("label"), F.inline(F.array(*each)))


@register("m10_tier_monotonicity", W("scored") + f"""SELECT risk_tier, tier_rank, actual_default_rate,
  lag(actual_default_rate) OVER (ORDER BY tier_rank) AS prev_default_rate,
  CASE WHEN lag(actual_default_rate) OVER (ORDER BY tier_rank) IS NULL THEN true
       ELSE actual_default_rate >= lag(actual_default_rate) OVER (ORDER BY tier_rank) END AS is_monotone_step
FROM (SELECT risk_tier, {TIER_RANK_SQL} AS tier_rank,
        CAST(sum(CAST(target AS BIGINT)) AS DOUBLE) / count(target) AS actual_default_rate
      FROM scored WHERE split = 'test' GROUP BY risk_tier)""")
def m10_tier_monotonicity(spark, d):
    return PF.tier_monotonicity(test_scored(spark, d))


# ---------------------------------------------------------------------------
# linear attribution of the formula model (T12) and its readers
# ---------------------------------------------------------------------------
ATTR = list(K.FORMULA_PD_COEFS)


def attribution_model(spark, d):
    feats = score_features(spark, d)
    model = EX.LinearAttribution.fit(scored_split(spark, d, "train", feats), K.FORMULA_PD_COEFS,
                                     K.FORMULA_PD_INTERCEPT)
    return model, scored_split(spark, d, "test", feats)


def attribution(spark, d) -> DataFrame:
    model, test = attribution_model(spark, d)
    return model.explain(test)


def _means_sql() -> str:
    parts = ", ".join(f"CAST({O.dsum(c, 8)} AS DOUBLE) / count({c}) AS {c}" for c in ATTR)
    return f", bg AS (SELECT {parts} FROM scored WHERE split = 'train')\n"


def _attr_rows_sql() -> str:
    rows = " UNION ALL ".join(
        f"SELECT s.loan_id, '{c}' AS feature, {i} AS ordinal, CAST(s.{c} AS DOUBLE) AS feature_value, "
        f"{K.FORMULA_PD_COEFS[c]} * (CAST(s.{c} AS DOUBLE) - bg.{c}) AS phi FROM scored s, bg WHERE s.split = 'test'"
        for i, c in enumerate(ATTR))
    return f", attr AS ({rows})\n"


ATTR_SQL = W("scored") + _means_sql() + _attr_rows_sql()


@register("t12_linear_attribution", ATTR_SQL + "SELECT loan_id, feature, phi FROM attr")
def t12_linear_attribution(spark, d):
    return attribution(spark, d).select("loan_id", "feature", "phi")


@register("x26_impact_label", ATTR_SQL + """SELECT loan_id, feature, CASE WHEN phi > 0 THEN 'increases_risk'
  WHEN phi < 0 THEN 'decreases_risk' ELSE 'neutral' END AS impact FROM attr""")
def x26_impact_label(spark, d):
    return attribution(spark, d).select("loan_id", "feature", "impact")


@register("x27_display_text", ATTR_SQL + "SELECT loan_id, feature, printf('%.2f', feature_value) AS display_value FROM attr")
def x27_display_text(spark, d):
    return attribution(spark, d).select("loan_id", "feature", "display_value")


@register("a15_mean_abs_attribution", ATTR_SQL + """SELECT feature,
  CAST(sum(CAST(abs(phi) AS DECIMAL(28,12))) AS DOUBLE) / count(*) AS mean_abs_phi FROM attr GROUP BY feature""")
def a15_mean_abs_attribution(spark, d):
    return EX.mean_abs_attribution(attribution(spark, d))


@register("w4_sort_by_importance", ATTR_SQL + """SELECT feature, mean_abs_phi,
  CAST(row_number() OVER (ORDER BY mean_abs_phi DESC, feature) AS INTEGER) AS importance_rank FROM (SELECT feature,
  CAST(sum(CAST(abs(phi) AS DECIMAL(28,12))) AS DOUBLE) / count(*) AS mean_abs_phi FROM attr GROUP BY feature)""")
def w4_sort_by_importance(spark, d):
    return EX.importance_ranking(EX.mean_abs_attribution(attribution(spark, d)))


@register("w5_top_features", ATTR_SQL + """SELECT feature, mean_abs_phi FROM (SELECT feature,
  CAST(sum(CAST(abs(phi) AS DECIMAL(28,12))) AS DOUBLE) / count(*) AS mean_abs_phi FROM attr GROUP BY feature)
ORDER BY mean_abs_phi DESC, feature LIMIT 2""")
def w5_top_features(spark, d):
    return EX.importance_ranking(EX.mean_abs_attribution(attribution(spark, d))).limit(2) \
        .select("feature", "mean_abs_phi")


@register("w6_top_factors_per_loan", ATTR_SQL + """SELECT loan_id, CAST(rk AS INTEGER) AS factor_rank, feature FROM (
  SELECT loan_id, feature, row_number() OVER (PARTITION BY loan_id ORDER BY abs(phi) DESC, ordinal) AS rk FROM attr)
WHERE rk <= 5""")
def w6_top_factors_per_loan(spark, d):
    model, test = attribution_model(spark, d)
    return model.top_factors(test, 5)


# ---------------------------------------------------------------------------
# scoring and portfolio jobs
# ---------------------------------------------------------------------------
@register("b2_score_batch", W("scored") + """SELECT loan_id, probability_of_default, risk_tier, credit_grade,
  recommended_action, policy_decision FROM scored""")
def b2_score_batch(spark, d):
    return scored(spark, d).select("loan_id", "probability_of_default", "risk_tier", "credit_grade",
                                   "recommended_action", "policy_decision")


@register("b6_portfolio_analysis", _portfolio_sql(f"WHERE split = 'test'"))
def b6_portfolio_analysis(spark, d):
    """Flagship: expected loss and decisions by risk tier on the out-of-time test cohort."""
    return PF.portfolio_summary(test_scored(spark, d))


@register("b7_cleaning_job", W("cleaned") + "SELECT * FROM cleaned")
def b7_cleaning_job(spark, d):
    return cleaned(spark, d)


@register("b8_feature_job", W("features") + "SELECT * FROM features")
def b8_feature_job(spark, d):
    return features(spark, d)


# ---------------------------------------------------------------------------
# application scoring: template (A14), overrides (P12), scoring (B4),
# scenarios (B5); the template is fitted on the test cohort's features
# ---------------------------------------------------------------------------
TEMPLATE_NUMERIC = [c for c in ("loan_amnt", "term", "annual_inc", "dti", "revol_bal", "revol_util",
                                "inq_last_6mths", "delinq_2yrs", "open_acc", "total_acc", "total_rev_hi_lim",
                                "tot_cur_bal", "pub_rec", "mths_since_last_delinq", "mths_since_last_record",
                                "tax_liens", "inq_last_12m", "num_accts_ever_120_pd", "emp_length_num",
                                "issue_month", "credit_history_months", "home_ownership_enc",
                                "verification_status_enc", "application_type_enc", "initial_list_status_enc")]
TEMPLATE_FEATURES = list(FE.FEATURE_NAMES)
TEMPLATE_TEXT = ["purpose", "addr_state"]


def template(spark, d, rows: DataFrame | None = None) -> DataFrame:
    """The template of the test cohort; pass feature ``rows`` that are written already to spare a cleaning run."""
    f = (features(spark, d) if rows is None else rows).where(F.col("issue_year") == K.FIXTURE_TEST_YEAR)
    num, cat = SC.template_columns(f)
    return SC.template_row(f, num, cat)


def _mode_sql(c: str) -> str:
    return (f"(SELECT {c} FROM features WHERE issue_year = {K.FIXTURE_TEST_YEAR} GROUP BY {c} "
            f"ORDER BY count(*) DESC, {c} LIMIT 1)")


TEMPLATE_SQL_CTE = ", tpl AS (SELECT " + ", ".join(
    [f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS {c}" for c in TEMPLATE_NUMERIC + TEMPLATE_FEATURES]
    + [f"{_mode_sql(c)} AS {c}" for c in TEMPLATE_TEXT]) + f" FROM features WHERE issue_year = {K.FIXTURE_TEST_YEAR})\n"


@register("a14_template_row", W("features") + TEMPLATE_SQL_CTE + "SELECT * FROM tpl")
def a14_template_row(spark, d):
    return template(spark, d)


APP_FIELDS = list(K.APPLICATION_FIELDS)
APPS_SQL_CTE = f""", apps AS (SELECT loan_id AS application_id, CAST(loan_amnt AS DOUBLE) AS loan_amnt,
  CAST(CAST(replace(trim(term), ' months', '') AS SMALLINT) AS INTEGER) AS term, CAST(annual_inc AS DOUBLE) AS annual_inc,
  CAST(dti AS DOUBLE) AS dti, CAST(revol_bal AS DOUBLE) AS revol_bal, CAST(revol_util AS DOUBLE) AS revol_util,
  CAST(delinq_2yrs AS INTEGER) AS delinq_2yrs
  FROM raw_loans WHERE {O._year('issue_d')} = {K.FIXTURE_TEST_YEAR})
"""


def _override_sql(apps: str, extra_cols: list[str], with_features: bool = False) -> str:
    cols = [f"a.{c}" for c in extra_cols]
    cols += [f"coalesce(CAST(a.{c} AS DOUBLE), t.{c}) AS {c}" for c in APP_FIELDS]
    cols += [f"t.{c}" for c in TEMPLATE_NUMERIC + TEMPLATE_TEXT if c not in APP_FIELDS]
    if with_features:
        cols += [f"t.{c}" for c in TEMPLATE_FEATURES]
    return f", ov AS (SELECT {', '.join(cols)} FROM {apps} a, tpl t)\n"


def _app_scoring_sql(apps: str, extra_cols: list[str]) -> str:
    feats = ", ".join(f"{e} AS {n}" for n, e in O.FEATURE_SQL.items())
    return (_override_sql(apps, extra_cols)
            + f", ofe AS (SELECT *, {feats} FROM ov)\n"
            + f", opd AS (SELECT *, {O.PD_SQL} AS pd FROM ofe)\n")


APP_OUT_SQL = f"""SELECT application_id, loan_pct_of_income, delinq_score, inquiry_score, open_acct_ratio,
  round(pd, 4) AS probability_of_default, {O._tier(O.CLAMP, 1)} AS risk_tier,
  CASE WHEN {N_RULES_SQL} > 0 THEN 'Deny' WHEN pd >= 0.22 THEN 'Refer' ELSE 'Approve' END AS policy_decision
FROM opd"""
B4_SQL = W("features") + TEMPLATE_SQL_CTE + APPS_SQL_CTE + _app_scoring_sql("apps", ["application_id"]) + APP_OUT_SQL
APP_OUT_COLS = ["application_id", "loan_pct_of_income", "delinq_score", "inquiry_score", "open_acct_ratio",
                "probability_of_default", "risk_tier", "policy_decision"]


def applications(spark, d) -> DataFrame:
    return SC.applications_from_loans(raw(spark, d), K.FIXTURE_TEST_YEAR)


@register("p12_template_override", W("features") + TEMPLATE_SQL_CTE + APPS_SQL_CTE
          + _override_sql("apps", ["application_id"], True) + "SELECT * FROM ov")
def p12_template_override(spark, d):
    return SC.override_template(applications(spark, d), template(spark, d))


@register("b4_application_scoring", B4_SQL)
def b4_application_scoring(spark, d):
    return SC.score_applications(applications(spark, d), template(spark, d)).select(*APP_OUT_COLS)


SCEN_VALUES = ", ".join(
    f"({i + 1}, '{n}', {a}, {t}, {inc}, {dti}, {rb}, {ru}, {dq})"
    for i, (n, a, t, inc, dti, rb, ru, dq) in enumerate(K.SCENARIOS))
SCEN_CTE = (", scen AS (SELECT CAST(application_id AS BIGINT) AS application_id, scenario, CAST(loan_amnt AS DOUBLE) AS "
            "loan_amnt, CAST(term AS INTEGER) AS term, CAST(annual_inc AS DOUBLE) AS annual_inc, CAST(dti AS DOUBLE) AS dti, "
            "CAST(revol_bal AS DOUBLE) AS revol_bal, CAST(revol_util AS DOUBLE) AS revol_util, "
            "CAST(delinq_2yrs AS INTEGER) AS delinq_2yrs FROM (VALUES " + SCEN_VALUES
            + ") v(application_id, scenario, loan_amnt, term, annual_inc, dti, revol_bal, revol_util, delinq_2yrs))\n")
B5_SQL = (W("features") + TEMPLATE_SQL_CTE + SCEN_CTE + _app_scoring_sql("scen", ["application_id", "scenario"])
          + f"""SELECT application_id, scenario, round({O.PCT_SQL}, 1) AS loan_to_income_pct, {RULES_SQL} AS rule_codes,
  CASE WHEN {N_RULES_SQL} > 0 THEN 'Deny' WHEN pd >= 0.22 THEN 'Refer' ELSE 'Approve' END AS policy_decision,
  round(pd, 4) AS probability_of_default, {O._tier(O.CLAMP, 1)} AS risk_tier FROM opd""")


@register("b5_scenarios", B5_SQL)
def b5_scenarios(spark, d):
    scored_apps = SC.score_applications(SC.scenario_frame(spark), template(spark, d))
    p = _policy_cols(scored_apps)
    return p.select("application_id", "scenario", "loan_to_income_pct", "rule_codes", "policy_decision",
                    "probability_of_default", "risk_tier")


@register("st1_stream_scoring", B4_SQL)
def st1_stream_scoring(spark, d):
    """Applications arrive as files; a stateless stream scores them against the template."""
    from pdforge.streaming.scoring_stream import score_application_files
    return score_application_files(spark, applications(spark, d), template(spark, d)).select(*APP_OUT_COLS)


# ---------------------------------------------------------------------------
# Metric comparison, PD model (baseline) vs a one-variable DTI scorecard
# ---------------------------------------------------------------------------
SCORECARD = "CAST(dti AS DOUBLE) / 100.0"
#: The two scores that are compared: the formula PD and a scorecard of one variable.
MODELS_SQL = {"baseline": "pd", "challenger": SCORECARD}


def compared_models() -> dict:
    return {"baseline": F.col("pd"), "challenger": F.col("dti").cast("double") / 100.0}


def _bundle_sql(score: str, tag: str, report: str = "test") -> str:
    sc = f"sc_{tag}"
    base = (curve_ctes("split = 'val'", f"_v{tag}", score) + metrics_sql(f"vt{tag}", f"_v{tag}")
            + confusion_sql(f"(SELECT youden_threshold FROM vt{tag})", f"split = '{report}'", score, tag)
            + curve_ctes(f"split = '{report}'", f"_t{tag}", score) + metrics_sql(f"mt{tag}", f"_t{tag}"))
    return base + f""", {sc} AS (SELECT round(roc_auc, 4) AS roc_auc, round(pr_auc, 4) AS pr_auc,
  round(2.0 * roc_auc - 1.0, 4) AS gini, round(ks_stat_pct, 2) AS ks_stat_pct, round(accuracy, 4) AS accuracy,
  round(precision, 4) AS default_precision, round(recall, 4) AS default_recall, round(f1, 4) AS default_f1,
  round((SELECT youden_threshold FROM vt{tag}), 4) AS threshold FROM mt{tag}, cm3{tag})
"""


J2_SQL = (W("scored") + _bundle_sql(MODELS_SQL["baseline"], "a") + _bundle_sql(MODELS_SQL["challenger"], "b")
          + "SELECT metric, baseline, challenger, round(challenger - baseline, 4) AS delta FROM ("
          + " UNION ALL ".join(f"SELECT '{c}' AS metric, CAST(a.{c} AS DOUBLE) AS baseline, "
                               f"CAST(b.{c} AS DOUBLE) AS challenger FROM sc_a a, sc_b b" for c in M.BUNDLE) + ")")


@register("j2_metric_comparison", J2_SQL)
def j2_metric_comparison(spark, d):
    return M.compare_models(M.evaluate_models(model_scores(spark, d, compared_models())))


_SPLIT_TAGS = [(m, s, f"{m[0]}_{s}") for m in MODELS_SQL for s in ("val", "test")]


@register("m9_models_by_split", W("scored") + "".join(_bundle_sql(MODELS_SQL[m], t, s) for m, s, t in _SPLIT_TAGS)
          + " UNION ALL ".join(f"SELECT '{m}' AS model, '{s}' AS split, {', '.join(M.BUNDLE)} FROM sc_{t}"
                               for m, s, t in _SPLIT_TAGS))
def m9_models_by_split(spark, d):
    """Every model on every labelled split at its validation threshold, from one grouped pass."""
    return M.evaluate_models(model_scores(spark, d, compared_models()), report=("val", "test"))


@register("b7_cleaning_fit_on_train", O.with_ctes("cleaned", fit_where=f"issue_year <= {K.FIXTURE_TRAIN_MAX_YEAR}")
          + "SELECT * FROM cleaned")
def b7_cleaning_fit_on_train(spark, d):
    """B7 with medians and caps fitted on the training years only (no validation / test leakage)."""
    from pdforge.plans.cleaning_job import run_cleaning
    return run_cleaning(raw(spark, d), fit_on=F.col("issue_year") <= K.FIXTURE_TRAIN_MAX_YEAR).cleaned
