"""DuckDB SQL of the sink, round-trip, sample and model queries.

A fitted model's numbers are beyond SQL, so the model queries return what SQL
knows exactly about them: the rows they score, that every PD is a probability,
that attributions add up to the log-odds, the levels and scales they fit.
"""

from __future__ import annotations

from pdforge import constants as K
from pdforge.plans import oracle as O
from pdforge.plans.catalog import A2_SQL, A8_SQL, SPLIT_SQL, W, _feature_numeric_names
from pdforge.plans.catalog_scoring import METRICS_SQL, N_RULES_SQL, confusion_sql, curve_ctes

RAW_ROWS = W("raw_loans") + "SELECT * FROM raw_loans"
TEST_YEAR_FEATURES = W("features") + f"SELECT * FROM features WHERE issue_year = {K.FIXTURE_TEST_YEAR}"

EXPORT = W("raw_loans") + """SELECT count(*) AS rows,
  CAST((SELECT count(*) FROM (DESCRIBE SELECT * FROM raw_loans)) AS INTEGER) AS columns, true AS has_bytes FROM raw_loans"""

SCHEMA = W("raw_loans") + """SELECT column_name AS column,
  CASE column_type WHEN 'VARCHAR' THEN 'string' ELSE lower(column_type) END AS type
FROM (DESCRIBE SELECT * FROM raw_loans)"""

BUCKETS = f"SELECT risk_tier, count, avg_pd, actual_default_rate FROM ({A8_SQL})"

METRICS_WITH_BUCKETS = (W("scored") + confusion_sql("0.22") + curve_ctes() + METRICS_SQL
                        + f""", b AS ({BUCKETS})
SELECT round(roc_auc, 4) AS roc_auc, round(pr_auc, 4) AS pr_auc, round(2.0 * roc_auc - 1.0, 4) AS gini,
  round(ks_stat_pct, 2) AS ks_stat_pct, round(accuracy, 4) AS accuracy, round(precision, 4) AS default_precision,
  round(recall, 4) AS default_recall, round(f1, 4) AS default_f1, CAST(0.22 AS DOUBLE) AS threshold, b.*
FROM mt, cm3, b""")

NOT_FEATURES = "('loan_id', 'target', 'issue_year', 'emp_title')"
FEATURE_KINDS = W("features") + f"""SELECT column_name AS column,
  CASE WHEN column_type = 'VARCHAR' THEN 'categorical' ELSE 'numeric' END AS kind
FROM (DESCRIBE SELECT * FROM features) WHERE column_name NOT IN {NOT_FEATURES}"""
ALIGNED = W("features") + "SELECT * EXCLUDE (target, issue_year, emp_title) FROM features"
SAVED_MODEL = f"SELECT 'Logistic Regression' AS name, * FROM ({FEATURE_KINDS})"

DECISIONS = W("scored") + f"""SELECT loan_id, 'formula' AS model, CAST(0.22 AS DOUBLE) AS threshold, probability_of_default,
  pd >= 0.22 AS predicted_default, risk_tier, credit_grade, {O._tier(O.CLAMP, 3)} AS recommended_interest_rate,
  {O._tier(O.CLAMP, 4)} AS risk_description, recommended_action, policy_decision AS decision,
  CASE policy_decision WHEN 'Deny' THEN '{K.COMMENT_DENY}' WHEN 'Refer' THEN '{K.COMMENT_REFER}'
       ELSE '{K.COMMENT_APPROVE}' END AS comments,
  CAST(CASE WHEN policy_decision = 'Deny' THEN {N_RULES_SQL} ELSE 0 END AS INTEGER) AS n_adverse FROM scored"""

JOB_SINK = f"""SELECT raw_rows, CAST((SELECT count(*) FROM (DESCRIBE {RAW_ROWS})) AS INTEGER) AS raw_columns, cleaned_rows,
  CAST((SELECT count(*) FROM (DESCRIBE {W('cleaned')} SELECT * FROM cleaned)) AS INTEGER) AS cleaned_columns,
  rows_removed, rows_removed_pct, default_count, non_default_count, default_rate_pct FROM ({A2_SQL})"""

LABELLED = f"(SELECT *, {SPLIT_SQL} AS split FROM features WHERE target IS NOT NULL)"
TEST_ROWS = W("features") + f"""SELECT loan_id, CAST(target AS INTEGER) AS label, true AS is_probability
FROM {LABELLED} WHERE split = 'test'"""
ROUND_TRIP = W("features") + f"SELECT loan_id, true AS same_pd FROM {LABELLED} WHERE split = 'test'"
ADDITIVE = W("features") + f"SELECT loan_id, true AS adds_up FROM {LABELLED} WHERE split = 'test'"

FOLDS = W("features") + f""", ranked AS (SELECT target, (row_number() OVER (PARTITION BY target ORDER BY loan_id) - 1) % 5 AS fold
  FROM {LABELLED} WHERE split IN ('train', 'val'))
SELECT CAST(fold AS INTEGER) AS fold, target, count(*) AS count FROM ranked GROUP BY ALL"""


def standardized() -> str:
    """Each numeric feature of the test rows, less the training mean, over the training deviation (n - 1)."""
    parts = " UNION ALL ".join(
        f"""SELECT loan_id, '{c}' AS feature, CASE WHEN s.d > 0 THEN round((coalesce(CAST({c} AS DOUBLE), 0.0) - s.m) / s.d, 6)
  ELSE 0.0 END AS scaled FROM r, (SELECT avg(coalesce(CAST({c} AS DOUBLE), 0.0)) AS m,
  stddev_samp(coalesce(CAST({c} AS DOUBLE), 0.0)) AS d FROM r WHERE split = 'train') s WHERE split = 'test'"""
        for c in _feature_numeric_names())
    return W("features") + f", r AS {LABELLED}\n" + parts


def one_hot(columns=("purpose", "addr_state")) -> str:
    """Position of each test row's level among the training levels (most frequent first); -1 for unseen ones."""
    parts = " UNION ALL ".join(
        f"""SELECT r.loan_id, '{c}' AS column, CAST(coalesce(l.i, -1) AS INTEGER) AS position FROM r LEFT JOIN
  (SELECT {c}, row_number() OVER (ORDER BY count(*) DESC, {c}) - 1 AS i FROM r
   WHERE split = 'train' AND {c} IS NOT NULL GROUP BY {c}) l ON r.{c} = l.{c} WHERE r.split = 'test'"""
        for c in columns)
    return W("features") + f", r AS {LABELLED}\n" + parts
