"""Fixed values that must equal the original project's for identical results.

Everything in this module is data, not logic: status sets, column lists, code
maps, tier cut-offs, rule limits and texts. They are kept in their natural
order and wording.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES — loan outcome
# ---------------------------------------------------------------------------
DEFAULT_STATUSES = ["Charged Off", "Default"]
NON_DEFAULT_STATUSES = ["Fully Paid"]

# ---------------------------------------------------------------------------
# FIXED VALUES — columns dropped before any processing
# ---------------------------------------------------------------------------
DROP_COLUMNS = ["id", "member_id", "url", "desc", "title", "zip_code", "policy_code", "pymnt_plan"]

JOINT_PREFIXES = ("sec_app_", "annual_inc_joint", "dti_joint", "verification_status_joint", "revol_bal_joint")

RAW_DATE_COLUMNS = ["issue_d", "earliest_cr_line", "last_credit_pull_d"]

# columns never used as model inputs (text / split keys)
NON_FEATURE_COLUMNS = ["target", "issue_year", "emp_title"]

# ---------------------------------------------------------------------------
# FIXED VALUES — leakage registry: category -> (description, risk, columns)
# ---------------------------------------------------------------------------
LEAKAGE_CATEGORIES = {
    "post_origination": (
        "Only known AFTER the loan is issued and payments begin",
        "Model learns outcome directly from payment behavior",
        ["out_prncp", "out_prncp_inv", "total_pymnt", "total_pymnt_inv", "total_rec_prncp",
         "total_rec_int", "total_rec_late_fee", "last_pymnt_d", "last_pymnt_amnt", "next_pymnt_d"],
    ),
    "post_default": (
        "Only exist AFTER a borrower defaults",
        "Directly reveals the target variable",
        ["recoveries", "collection_recovery_fee"],
    ),
    "lender_assigned": (
        "Set by the lender BASED ON their own risk model",
        "Circular reasoning — using the lender's risk score to predict risk",
        ["grade", "sub_grade", "int_rate", "installment", "funded_amnt", "funded_amnt_inv"],
    ),
    "hardship_program": (
        "From hardship programs entered AFTER loan origination",
        "Hardship enrollment happens only when borrower is struggling",
        ["hardship_flag", "hardship_type", "hardship_reason", "hardship_status", "deferral_term",
         "hardship_amount", "hardship_start_date", "hardship_end_date", "payment_plan_start_date",
         "hardship_length", "hardship_dpd", "hardship_loan_status",
         "orig_projected_additional_accrued_interest", "hardship_payoff_balance_amount",
         "hardship_last_payment_amount"],
    ),
    "settlement": (
        "From debt settlement AFTER default",
        "Settlement only happens after default — directly reveals target",
        ["debt_settlement_flag", "debt_settlement_flag_date", "settlement_status", "settlement_date",
         "settlement_amount", "settlement_percentage", "settlement_term"],
    ),
}

# ---------------------------------------------------------------------------
# FIXED VALUES — imputation and capping
# ---------------------------------------------------------------------------
NEVER_HAPPENED_COLUMNS = [
    "mths_since_last_delinq",
    "mths_since_last_record",
    "mths_since_last_major_derog",
    "mths_since_recent_bc_dlq",
    "mths_since_recent_revol_delinq",
]
NEVER_HAPPENED_FILL = 999

ZERO_FILL_COLUMNS = [
    "pub_rec_bankruptcies", "tax_liens", "chargeoff_within_12_mths", "collections_12_mths_ex_med",
    "delinq_amnt", "acc_now_delinq", "num_tl_120dpd_2m", "num_tl_30dpd", "num_tl_90g_dpd_24m",
]

MEDIAN_FILL_COLUMNS = [
    "annual_inc", "dti", "revol_util", "open_acc", "total_acc",
    "revol_bal", "delinq_2yrs", "inq_last_6mths", "pub_rec",
    "tot_coll_amt", "tot_cur_bal", "total_rev_hi_lim",
    "bc_util", "bc_open_to_buy", "avg_cur_bal", "mort_acc",
    "pct_tl_nvr_dlq", "percent_bc_gt_75", "all_util",
    "num_actv_bc_tl", "num_actv_rev_tl", "num_bc_sats",
    "num_bc_tl", "num_il_tl", "num_op_rev_tl", "num_rev_accts",
    "num_rev_tl_bal_gt_0", "num_sats", "num_tl_op_past_12m",
    "tot_hi_cred_lim", "total_bal_ex_mort", "total_bc_limit",
    "total_il_high_credit_limit", "total_bal_il", "il_util",
    "max_bal_bc", "open_acc_6m", "open_act_il", "open_il_12m",
    "open_il_24m", "open_rv_12m", "open_rv_24m",
    "mths_since_rcnt_il", "mths_since_recent_bc",
    "mths_since_recent_inq", "mo_sin_old_il_acct",
    "mo_sin_old_rev_tl_op", "mo_sin_rcnt_rev_tl_op",
    "mo_sin_rcnt_tl", "inq_fi", "total_cu_tl", "inq_last_12m",
    "acc_open_past_24mths", "num_accts_ever_120_pd",
]

CAP_COLUMNS = ["annual_inc", "dti", "revol_bal", "open_acc", "total_acc", "tot_cur_bal", "tot_coll_amt", "revol_util"]
CAP_QUANTILE = 0.995

FLOAT32_COLUMNS = [
    "loan_amnt", "annual_inc", "dti", "revol_bal", "revol_util",
    "tot_coll_amt", "tot_cur_bal", "total_rev_hi_lim",
    "avg_cur_bal", "bc_open_to_buy", "bc_util",
    "pct_tl_nvr_dlq", "percent_bc_gt_75", "all_util",
    "tot_hi_cred_lim", "total_bal_ex_mort", "total_bc_limit",
    "total_il_high_credit_limit", "total_bal_il", "il_util",
    "max_bal_bc",
]

# ---------------------------------------------------------------------------
# FIXED VALUES — ordinal code maps (unmapped or null -> 0)
# ---------------------------------------------------------------------------
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

HOME_OWNERSHIP_CODES = {"OWN": 3, "MORTGAGE": 2, "RENT": 1, "OTHER": 0, "NONE": 0, "ANY": 0}
VERIFICATION_CODES = {"Verified": 2, "Source Verified": 1, "Not Verified": 0}
APPLICATION_TYPE_CODES = {"Individual": 0, "Joint App": 1}
LIST_STATUS_CODES = {"f": 0, "w": 1}

ENCODED_CATEGORICALS = {
    "home_ownership": HOME_OWNERSHIP_CODES,
    "verification_status": VERIFICATION_CODES,
    "application_type": APPLICATION_TYPE_CODES,
    "initial_list_status": LIST_STATUS_CODES,
}

# ---------------------------------------------------------------------------
# FIXED VALUES — out-of-time split; the fixture's calendar is shifted (see FIXTURES.md)
# ---------------------------------------------------------------------------
TRAIN_MAX_YEAR = 2016
VAL_YEAR = 2017
TEST_YEAR = 2018
FIXTURE_TRAIN_MAX_YEAR = 1999
FIXTURE_VAL_YEAR = 2000
FIXTURE_TEST_YEAR = 2001
FIXTURE_SPLIT = {"train_max": FIXTURE_TRAIN_MAX_YEAR, "val_year": FIXTURE_VAL_YEAR, "test_year": FIXTURE_TEST_YEAR}

# ---------------------------------------------------------------------------
# FIXED VALUES — risk tiers: (upper PD bound, tier, grade, rate range, description, action)
# ---------------------------------------------------------------------------
RISK_TIERS = [
    (0.05, "Very Low", "A", "5.0% - 8.5%",
     "Excellent credit profile. Extremely low likelihood of default.", "Approve"),
    (0.12, "Low", "B", "8.6% - 12.0%",
     "Solid credit profile. Below average default risk.", "Approve"),
    (0.22, "Medium", "C", "12.1% - 17.5%",
     "Moderate credit risk. Close to baseline default rate.", "Approve (Review)"),
    (0.35, "High", "D", "17.6% - 24.0%",
     "Elevated risk profile. Substantially above average default probability.", "Conditional Approve"),
    (None, "Very High", "E/F", "N/A",
     "Critical risk profile. Default probability exceeds acceptable thresholds.", "Deny"),
]
TIER_ORDER = ["Very Low", "Low", "Medium", "High", "Very High"]

# ---------------------------------------------------------------------------
# FIXED VALUES — knock-out policy
# ---------------------------------------------------------------------------
POLICY_PD_DENY = 0.35
POLICY_PD_REFER = 0.22
POLICY_MAX_DTI = 50.0
POLICY_MAX_INQUIRIES = 5
POLICY_MAX_DELINQUENCIES = 3
POLICY_MAX_LOAN_PCT_INCOME = 45.0

REASON_PD = "Default probability exceeds maximum credit risk threshold (35%)."
REASON_DTI = "Debt-to-Income (DTI) ratio exceeds credit policy limit (50%)."
REASON_INQUIRIES = "Recent credit inquiries (past 6 months) exceed acceptable limit (max 5)."
REASON_DELINQUENCIES = "Number of delinquencies in past 2 years exceeds policy threshold (max 3)."
REASON_LEVERAGE_FMT = "Requested loan amount is too high relative to income ({pct}% of income, limit is 45%)."

COMMENT_DENY = "Application denied based on credit policy rules."
COMMENT_REFER = "Application referred to manual underwriting due to moderate credit risk."
COMMENT_APPROVE = "Application meets all credit policy criteria."

# batch / single scoring defaults when an input is missing
POLICY_INPUT_DEFAULTS = {"dti": 0.0, "inq_last_6mths": 0.0, "delinq_2yrs": 0.0,
                         "annual_inc": 1.0, "loan_amnt": 1.0}

# ---------------------------------------------------------------------------
# FIXED VALUES — portfolio
# ---------------------------------------------------------------------------
DEFAULT_LGD = 0.60

# ---------------------------------------------------------------------------
# FIXED VALUES — online application form and presets
# ---------------------------------------------------------------------------
APPLICATION_FIELDS = ["loan_amnt", "term", "annual_inc", "dti", "revol_bal", "revol_util", "delinq_2yrs"]

SCENARIOS = [
    ("Prime Borrower (Very Low Risk)", 15000.0, 36, 125000.0, 10.0, 6000.0, 12.5, 0),
    ("Subprime Borrower (High Risk)", 28000.0, 60, 42000.0, 32.5, 25000.0, 88.0, 2),
    ("Debt-Stressed Applicant", 30000.0, 60, 55000.0, 48.5, 14000.0, 72.0, 0),
    ("High Risk (Multiple Delinquencies)", 10000.0, 36, 48000.0, 18.0, 7500.0, 35.0, 4),
]

# ---------------------------------------------------------------------------
# FIXED VALUES — model defaults
# ---------------------------------------------------------------------------
LR_MAX_ITER = 1000
GBT_DEFAULTS = {"n_estimators": 300, "learning_rate": 0.05, "num_leaves": 31, "min_child_samples": 50,
                "subsample": 0.8, "colsample_bytree": 0.8}
LR_C_RANGE = (0.001, 10.0)
LR_MAX_ITER_CHOICES = [500, 1000]
RANDOM_SEED = 42

# formula PD used wherever a closed-form score is needed for exact checks
FORMULA_PD_INTERCEPT = -3.2
FORMULA_PD_COEFS = {"delinq_2yrs": 0.45, "dti": 0.02, "loan_pct_of_income": 0.008}
