"""DuckDB oracle SQL: the same loan table and cleaning written as plain SQL.

These texts are the independent side of the correctness check: the Spark
side computes medians/caps with distributed prefix sums, curves with two-level
running sums, etc.; the SQL side uses ``quantile_cont`` and single window
functions over the whole table (fine for a check, not for 100 TB).

Column lists are generated from the same fixed-value lists as the engine so
the two stay in step; no value is computed here.
"""

from __future__ import annotations

from pdforge import constants as K

# ---------------------------------------------------------------------------
# raw loan view (FIXTURES.md §6)
# ---------------------------------------------------------------------------
LOAN_VIEW = r"""
li AS (
  SELECT l_orderkey,
         count(*) AS n,
         count(*) FILTER (WHERE l_returnflag = 'R') AS n_ret,
         CAST(sum(CAST(round(l_quantity * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS qty,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS ext,
         CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / 100.0 / count(*) AS disc
  FROM lineitem GROUP BY l_orderkey
),
raw_loans AS (
  SELECT
    CAST(o.o_orderkey AS VARCHAR) AS id,
    CAST(o.o_custkey AS VARCHAR) AS member_id,
    'loan/' || CAST(o.o_orderkey AS VARCHAR) AS url,
    CAST(1.0 AS DOUBLE) AS policy_code,
    o.o_orderkey AS loan_id,
    CASE WHEN o.o_orderstatus = 'P' AND o.o_orderkey % 3 = 0 THEN 'Current'
         WHEN o.o_orderstatus = 'P' AND o.o_orderkey % 3 = 1 THEN 'Late (31-120 days)'
         WHEN coalesce(li.n_ret, 0) >= 3 OR o.o_orderkey % 7 = 0 THEN
              CASE WHEN o.o_orderkey % 2 = 0 THEN 'Charged Off' ELSE 'Default' END
         ELSE 'Fully Paid' END AS loan_status,
    CAST(round(CAST(o.o_totalprice AS DECIMAL(18,2)) * CAST(0.08 AS DECIMAL(3,2)), 2) AS DOUBLE) AS loan_amnt,
    CASE WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN ' 60 months' ELSE ' 36 months' END AS term,
    CASE WHEN o.o_custkey % 13 = 0 THEN '< 1 year'
         WHEN o.o_custkey % 13 = 1 THEN '1 year'
         WHEN o.o_custkey % 13 <= 9 THEN CAST(o.o_custkey % 13 AS VARCHAR) || ' years'
         WHEN o.o_custkey % 13 = 10 THEN '10+ years'
         WHEN o.o_custkey % 13 = 11 THEN 'n/a' END AS emp_length,
    c.c_name AS emp_title,
    strftime(o.o_orderdate, '%b-%Y') AS issue_d,
    strftime(o.o_orderdate - to_months(CAST(12 + (o.o_custkey * 7) % 300 AS INTEGER)), '%b-%Y') AS earliest_cr_line,
    strftime(o.o_orderdate, '%b-%Y') AS last_credit_pull_d,
    CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'OWN' WHEN 'BUILDING' THEN 'MORTGAGE'
         WHEN 'FURNITURE' THEN 'RENT' WHEN 'HOUSEHOLD' THEN 'ANY' END AS home_ownership,
    CASE WHEN o.o_custkey % 3 = 0 THEN 'Verified' WHEN o.o_custkey % 3 = 1 THEN 'Source Verified'
         ELSE 'Not Verified' END AS verification_status,
    CASE WHEN o.o_orderkey % 10 = 0 THEN 'Joint App' ELSE 'Individual' END AS application_type,
    CASE WHEN o.o_orderkey % 2 = 0 THEN 'w' ELSE 'f' END AS initial_list_status,
    o.o_orderpriority AS purpose,
    n.n_name AS addr_state,
    CASE WHEN c.c_acctbal < 0 THEN CAST(NULL AS DOUBLE) ELSE c.c_acctbal * 20 END AS annual_inc,
    li.qty / 4.0 AS dti,
    li.ext / 20.0 AS revol_bal,
    li.disc * 1000 AS revol_util,
    CAST(coalesce(li.n, 0) % 8 AS DOUBLE) AS inq_last_6mths,
    CAST(coalesce(li.n_ret, 0) AS DOUBLE) AS delinq_2yrs,
    CAST(li.n + 2 AS DOUBLE) AS open_acc,
    CAST(li.n + 2 + o.o_custkey % 9 AS DOUBLE) AS total_acc,
    li.ext / 10 + (o.o_custkey % 7) * 1000 AS total_rev_hi_lim,
    li.ext / 4 AS tot_cur_bal,
    CAST(o.o_orderkey % 4 AS DOUBLE) AS pub_rec,
    CASE WHEN coalesce(li.n_ret, 0) = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(o.o_orderkey % 80 AS DOUBLE) END
      AS mths_since_last_delinq,
    CASE WHEN o.o_orderkey % 4 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(o.o_custkey % 120 AS DOUBLE) END
      AS mths_since_last_record,
    CASE WHEN o.o_orderkey % 5 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(o.o_orderkey % 3 AS DOUBLE) END AS tax_liens,
    CAST(li.n % 5 + o.o_custkey % 3 AS DOUBLE) AS inq_last_12m,
    CASE WHEN o.o_orderkey % 11 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(coalesce(li.n_ret, 0) % 3 AS DOUBLE) END
      AS num_accts_ever_120_pd,
    CAST(NULL AS DOUBLE) AS il_util,
    substring('ABCDEFG', CAST(o.o_custkey % 7 AS INTEGER) + 1, 1) AS grade,
    5.0 + (o.o_orderkey % 200) / 10.0 AS int_rate,
    o.o_totalprice AS total_pymnt,
    CASE WHEN o.o_orderkey % 7 = 0 THEN o.o_totalprice / 100.0 ELSE 0.0 END AS recoveries,
    CASE WHEN o.o_orderkey % 10 = 0 THEN c.c_acctbal * 30 ELSE CAST(NULL AS DOUBLE) END AS annual_inc_joint,
    CASE WHEN o.o_orderkey % 10 = 0 THEN CAST(o.o_custkey % 6 AS DOUBLE) ELSE CAST(NULL AS DOUBLE) END
      AS sec_app_open_acc
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN li ON o.o_orderkey = li.l_orderkey
)"""

# raw columns by role (fixture schema)
RAW_NUMERIC = ["loan_amnt", "annual_inc", "dti", "revol_bal", "revol_util", "inq_last_6mths", "delinq_2yrs",
               "open_acc", "total_acc", "total_rev_hi_lim", "tot_cur_bal", "pub_rec", "mths_since_last_delinq",
               "mths_since_last_record", "tax_liens", "inq_last_12m", "num_accts_ever_120_pd", "il_util"]
ALL_NULL_BY_CONSTRUCTION = ["il_util"]


def _month(expr: str) -> str:
    whens = " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(K.MONTHS, start=1))
    return f"(CASE substring({expr}, 1, 3) {whens} ELSE 0 END)"


def _codes(col: str, codes: dict) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in codes.items())
    return f"CAST((CASE {col} {whens} ELSE 0 END) AS TINYINT)"


def _year(expr: str) -> str:
    return f"CAST(substring({expr}, 5) AS SMALLINT)"


PREPARED = f"""
prepared AS (
  SELECT loan_id,
    CAST(CASE WHEN loan_status IN ('Charged Off', 'Default') THEN 1
              WHEN loan_status IN ('Fully Paid') THEN 0 END AS TINYINT) AS target,
    loan_amnt,
    CAST(replace(trim(term), ' months', '') AS SMALLINT) AS term,
    CAST(coalesce(CAST(trim(regexp_replace(regexp_replace(replace(
         CASE WHEN emp_length = 'n/a' THEN NULL ELSE emp_length END, '< 1 year', '0'),
         '\\+ years?', ''), ' years?', '')) AS FLOAT), -1.0) AS TINYINT) AS emp_length_num,
    emp_title, home_ownership, verification_status, application_type, initial_list_status,
    purpose, addr_state,
    {_year('issue_d')} AS issue_year,
    CAST({_month('issue_d')} AS TINYINT) AS issue_month,
    CAST((CAST({_year('issue_d')} AS INTEGER) - CAST({_year('earliest_cr_line')} AS INTEGER)) * 12
         + ({_month('issue_d')} - {_month('earliest_cr_line')}) AS SMALLINT) AS credit_history_months,
    annual_inc, dti, revol_bal, revol_util, inq_last_6mths, delinq_2yrs, open_acc, total_acc,
    total_rev_hi_lim, tot_cur_bal, pub_rec,
    coalesce(mths_since_last_delinq, 999) AS mths_since_last_delinq,
    coalesce(mths_since_last_record, 999) AS mths_since_last_record,
    coalesce(tax_liens, 0) AS tax_liens,
    inq_last_12m, num_accts_ever_120_pd, il_util
  FROM raw_loans
  WHERE loan_status IN ('Charged Off', 'Default', 'Fully Paid')
)"""

MEDIAN_COLS = [c for c in K.MEDIAN_FILL_COLUMNS if c in RAW_NUMERIC]
CAP_COLS = [c for c in K.CAP_COLUMNS if c in RAW_NUMERIC]


def _fitted(fit_where: str | None = None) -> str:
    meds = ",\n    ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in MEDIAN_COLS)
    caps = ",\n    ".join(f"quantile_cont(coalesce(p.{c}, m.{c}), {K.CAP_QUANTILE}) AS {c}" for c in CAP_COLS)
    w = f" WHERE {fit_where}" if fit_where else ""
    return f"""
med AS (SELECT
    {meds}
  FROM prepared{w}),
cap AS (SELECT
    {caps}
  FROM prepared p, med m{w})"""


def _cleaned_value(c: str) -> str:
    v = f"p.{c}"
    if c in MEDIAN_COLS:
        v = f"coalesce({v}, m.{c})"
    if c in CAP_COLS:
        v = f"(CASE WHEN {v} > k.{c} THEN k.{c} ELSE {v} END)"
    if c in K.FLOAT32_COLUMNS:
        v = f"TRY_CAST({v} AS FLOAT)"
    return f"{v} AS {c}"


def _cleaned() -> str:
    nums = [c for c in RAW_NUMERIC if c not in ALL_NULL_BY_CONSTRUCTION]
    enc = ",\n    ".join(f"{_codes('p.' + c, codes)} AS {c}_enc" for c, codes in K.ENCODED_CATEGORICALS.items())
    vals = ",\n    ".join(_cleaned_value(c) for c in nums)
    return f"""
cleaned AS (SELECT
    p.loan_id, p.target, p.term, p.emp_length_num, p.emp_title, p.purpose, p.addr_state,
    p.issue_year, p.issue_month, p.credit_history_months,
    {enc},
    {vals}
  FROM prepared p, med m, cap k)"""


def _d(c: str) -> str:
    return f"CAST({c} AS DOUBLE)"


def _clip(x: str) -> str:
    return f"(CASE WHEN {x} < 1.0 THEN 1.0 ELSE {x} END)"


FEATURE_SQL = {
    "income_to_loan": f"CAST({_d('annual_inc')} / {_clip(_d('loan_amnt'))} AS FLOAT)",
    "loan_pct_of_income": f"CAST({_d('loan_amnt')} / {_clip(_d('annual_inc'))} * 100.0 AS FLOAT)",
    "monthly_debt_dollar": f"CAST({_d('dti')} / 100.0 * {_d('annual_inc')} / 12.0 AS FLOAT)",
    "credit_util_x_balance": f"CAST({_d('revol_util')} * {_d('revol_bal')} / 10000.0 AS FLOAT)",
    "delinq_score": "CAST(0.0 + coalesce(CAST(delinq_2yrs AS DOUBLE), 0.0) * 2.0 + coalesce(CAST(pub_rec AS DOUBLE), 0.0)"
                    " * 3.0 + coalesce(CAST(num_accts_ever_120_pd AS DOUBLE), 0.0) AS FLOAT)",
    "inquiry_score": "CAST(coalesce(CAST(inq_last_6mths AS DOUBLE), 0.0) * 2.0 "
                     "+ coalesce(CAST(inq_last_12m AS DOUBLE), 0.0) AS FLOAT)",
    "open_acct_ratio": f"CAST({_d('open_acc')} / {_clip(_d('total_acc'))} AS FLOAT)",
    "balance_vs_income": f"CAST({_d('tot_cur_bal')} / {_clip(_d('annual_inc'))} AS FLOAT)",
    "credit_age_group": "CAST(CASE WHEN credit_history_months < 60 THEN 0 WHEN credit_history_months < 120 THEN 1 "
                        "WHEN credit_history_months < 180 THEN 2 ELSE 3 END AS TINYINT)",
    "revol_bal_vs_limit": f"CAST({_d('revol_bal')} / {_clip(_d('total_rev_hi_lim'))} AS FLOAT)",
}


def _features() -> str:
    feats = ",\n    ".join(f"{e} AS {n}" for n, e in FEATURE_SQL.items())
    return f"""
features AS (SELECT *,
    {feats}
  FROM cleaned)"""


PD_SQL = ("1.0 / (1.0 + exp(-(-3.2 + 0.45 * CAST(delinq_2yrs AS DOUBLE) + 0.02 * CAST(dti AS DOUBLE)"
          " + 0.008 * CAST(loan_pct_of_income AS DOUBLE))))")


def _tier(p: str, idx: int) -> str:
    parts = []
    for row in K.RISK_TIERS:
        if row[0] is None:
            parts.append(f"ELSE '{row[idx]}' END")
        else:
            parts.append(f"WHEN {p} < {row[0]} THEN '{row[idx]}'")
    return "(CASE " + " ".join(parts) + ")"


CLAMP = "greatest(0.0, least(1.0, pd))"
PCT_SQL = "(CAST(loan_amnt AS DOUBLE) / coalesce(greatest(CAST(annual_inc AS DOUBLE), 1.0), 1.0) * 100.0)"


def _scored() -> str:
    rules = (f"(pd >= 0.35 OR coalesce(CAST(dti AS DOUBLE), 0.0) > 50.0 OR coalesce(inq_last_6mths, 0.0) > 5 "
             f"OR coalesce(delinq_2yrs, 0.0) > 3 OR {PCT_SQL} > 45.0)")
    return f"""
with_pd AS (SELECT *, {PD_SQL} AS pd,
    CASE WHEN issue_year <= {K.FIXTURE_TRAIN_MAX_YEAR} THEN 'train' WHEN issue_year = {K.FIXTURE_VAL_YEAR} THEN 'val'
         WHEN issue_year = {K.FIXTURE_TEST_YEAR} THEN 'test' END AS split
  FROM features),
scored AS (SELECT *,
    round(pd, 4) AS probability_of_default,
    {_tier(CLAMP, 1)} AS risk_tier,
    {_tier(CLAMP, 2)} AS credit_grade,
    {_tier(CLAMP, 5)} AS recommended_action,
    CASE WHEN {rules} THEN 'Deny' WHEN pd >= 0.22 THEN 'Refer' ELSE 'Approve' END AS policy_decision,
    coalesce(CAST(loan_amnt AS DOUBLE), 0.0) AS ead
  FROM with_pd),
losses AS (SELECT *, probability_of_default * {K.DEFAULT_LGD} * ead AS expected_loss FROM scored)"""


def with_ctes(*names: str, fit_where: str | None = None) -> str:
    """WITH clause up to the named stage: raw_loans, prepared, cleaned, features, scored.

    ``fit_where`` restricts the rows the medians / caps are fitted on.
    """
    order = ["raw_loans", "prepared", "cleaned", "features", "scored"]
    upto = max(order.index(n) for n in names) if names else 0
    parts = [LOAN_VIEW]
    if upto >= 1:
        parts.append(PREPARED)
    if upto >= 2:
        parts.append(_fitted(fit_where))
        parts.append(_cleaned())
    if upto >= 3:
        parts.append(_features())
    if upto >= 4:
        parts.append(_scored())
    return "WITH " + ",".join(p.strip("\n") for p in parts) + "\n"


def dsum(expr: str, scale: int = 4) -> str:
    return f"sum(CAST(CAST({expr} AS DOUBLE) AS DECIMAL(28,{scale})))"
