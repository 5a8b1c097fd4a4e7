"""Named queries: ``<id>_<name>`` -> Spark callable (spark, sf_dir) -> DataFrame,
and the matching DuckDB SQL where the operator is SQL-expressible.

Every query reads the driver's tables (through the loan fixture) and runs
over all rows. Float outputs that are sums are taken over exact decimals in
both engines; per-row values are the same IEEE operations in both.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pdforge import constants as K
from pdforge.functions import features as FE
from pdforge.operators import cleaning as CL
from pdforge.operators import columns as C
from pdforge.operators import leakage as LK
from pdforge.operators import portfolio as PF
from pdforge.operators import scoring as SC
from pdforge.operators import splits as SP
from pdforge.plans import oracle as O
from pdforge.plans.cleaning_job import cleaning_statistics, run_cleaning, target_distribution
from pdforge.session import materialize
from pdforge.sources.fixtures import raw_loans

QUERIES: dict = {}
SQL: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------------------
# shared stages (Spark)
# ---------------------------------------------------------------------------
def raw(spark: SparkSession, d: str) -> DataFrame:
    return raw_loans(spark, d)


def prepared(spark, d) -> DataFrame:
    return CL.impute_fixed(CL.prepare_for_imputation(raw(spark, d)))


def cleaned(spark, d, columns: list | None = None) -> DataFrame:
    return run_cleaning(raw(spark, d), columns=columns).cleaned


def prepared_columns(spark, d, columns: list) -> DataFrame:
    """The named prepared columns, written once: the passes that fit them do not repeat the raw joins."""
    return materialize(prepared(spark, d).select(*columns), "prepared_columns")


def resolved(spark, d) -> DataFrame:
    """Resolved, parsed loans for queries that read no fitted column: one lazy plan, pruned to what they select."""
    return CL.prepare_for_imputation(raw(spark, d))


def features(spark, d, columns: list | None = None) -> DataFrame:
    return FE.add_features(cleaned(spark, d, columns))


#: What the formula PD, the policy rules and the four mandatory features read.
SCORED_COLUMNS = ["loan_id", "target", "issue_year", "loan_amnt", "annual_inc", "dti", "revol_bal", "revol_util",
                  "inq_last_6mths", "delinq_2yrs"]


def score_features(spark, d) -> DataFrame:
    return features(spark, d, SCORED_COLUMNS)


def scored(spark, d) -> DataFrame:
    f = SP.with_split(score_features(spark, d), **K.FIXTURE_SPLIT)
    return SC.score_batch(SC.with_formula_pd(f))


def scored_split(spark, d, name: str, feats: DataFrame | None = None) -> DataFrame:
    """Scored rows of one split; the filter is on the year, so it reaches the scan.

    Pass ``feats`` to reuse one cleaning run for several splits of the same query.
    """
    f = feats if feats is not None else score_features(spark, d)
    f = SP.with_split(f.where(SP.split_predicate(name, **K.FIXTURE_SPLIT)), **K.FIXTURE_SPLIT)
    return SC.score_batch(SC.with_formula_pd(f))


def test_scored(spark, d) -> DataFrame:
    return scored_split(spark, d, "test")


def labelled(df: DataFrame, score: str = "pd") -> DataFrame:
    return df.select("loan_id", F.col("target").cast("int").alias("label"), F.col(score).alias("score"))


W = O.with_ctes


def sql_from(stage: str, body: str) -> str:
    return W(stage) + body


# ---------------------------------------------------------------------------
# sources
# ---------------------------------------------------------------------------
@register("s2_row_count", sql_from("raw_loans", "SELECT count(*) AS rows FROM raw_loans"))
def s2_row_count(spark, d):
    return raw(spark, d).agg(F.count(F.lit(1)).alias("rows"))


CSV_COLS = ["loan_id", "loan_status", "loan_amnt", "term", "emp_length", "issue_d", "annual_inc", "dti",
            "home_ownership", "purpose"]


@register("s1_csv_scan", sql_from("raw_loans", f"SELECT {', '.join(CSV_COLS)} FROM raw_loans"))
def s1_csv_scan(spark, d):
    from pdforge.sources import io
    path = io.write_scratch(raw(spark, d).select(*CSV_COLS), "csv", "loans_csv")
    return io.read_loans_csv(spark, path).select(*CSV_COLS)


def _broken_csv(spark, d) -> str:
    """The loans as CSV with the columns in another order and an unparsable income in every tenth loan."""
    from pdforge.sources import io
    rows = raw(spark, d).select(*CSV_COLS).withColumn(
        "annual_inc", F.when(F.col("loan_id") % 10 == 3, F.lit("n/a")).otherwise(F.col("annual_inc").cast("string")))
    return io.write_scratch(rows.select(*reversed(CSV_COLS)), "csv", "broken_csv")


@register("s1_csv_contract", sql_from("raw_loans", """SELECT loan_id, loan_status, issue_d, dti,
  CASE WHEN loan_id % 10 <> 3 THEN annual_inc END AS annual_inc, loan_id % 10 = 3 AS is_bad FROM raw_loans"""))
def s1_csv_contract(spark, d):
    from pdforge.sources import io
    rows = io.read_loans_csv(spark, _broken_csv(spark, d), required=CSV_COLS, keep_bad=True)
    return rows.select("loan_id", "loan_status", "issue_d", "dti", "annual_inc",
                       F.col(io.CORRUPT).isNotNull().alias("is_bad"))


@register("s1_csv_bad_cells", sql_from("raw_loans", """SELECT unnest(['loan_id', 'loan_amnt', 'annual_inc', 'dti']) AS "column",
  unnest([0, 0, count(*) FILTER (WHERE loan_id % 10 = 3), 0]) AS bad_cells FROM raw_loans"""))
def s1_csv_bad_cells(spark, d):
    from pdforge.sources import io
    return io.csv_bad_cells(spark, _broken_csv(spark, d))


@register("s6_parquet_read", sql_from("raw_loans", "SELECT * FROM raw_loans"))
def s6_parquet_read(spark, d):
    from pdforge.sources import io
    path = io.write_scratch(raw(spark, d), "parquet", "loans_parquet")
    return spark.read.parquet(path)


# ---------------------------------------------------------------------------
# projections
# ---------------------------------------------------------------------------
def _excl(cols):
    return "SELECT * EXCLUDE (" + ", ".join(cols) + ") FROM raw_loans"


@register("p1_drop_static", sql_from("raw_loans", _excl(["id", "member_id", "url", "policy_code"])))
def p1_drop_static(spark, d):
    return C.drop_static_columns(raw(spark, d))


@register("p2_drop_leakage", sql_from("raw_loans", _excl(["grade", "int_rate", "total_pymnt", "recoveries"])))
def p2_drop_leakage(spark, d):
    return C.drop_leakage_columns(raw(spark, d))


@register("p3_drop_joint", sql_from("raw_loans", _excl(["annual_inc_joint", "sec_app_open_acc"])))
def p3_drop_joint(spark, d):
    return C.drop_joint_columns(raw(spark, d))


@register("p4_drop_all_null", sql_from("raw_loans", _excl(["il_util"])))
def p4_drop_all_null(spark, d):
    return C.drop_all_null_columns(raw(spark, d))


@register("p5_drop_temp", sql_from("raw_loans", "SELECT * FROM raw_loans"))
def p5_drop_temp(spark, d):
    r = raw(spark, d).withColumn("_month_str", F.substring("issue_d", 1, 3))
    return C.drop_temp_columns(r)


@register("p6_drop_non_features", sql_from("features", "SELECT * EXCLUDE (target, issue_year, emp_title) FROM features"))
def p6_drop_non_features(spark, d):
    return C.drop_non_features(features(spark, d))


P7_SQL = sql_from("raw_loans", f"""SELECT * EXCLUDE (issue_d, earliest_cr_line, last_credit_pull_d),
  {O._year('issue_d')} AS issue_year,
  CAST({O._month('issue_d')} AS TINYINT) AS issue_month,
  CAST((CAST({O._year('issue_d')} AS INTEGER) - CAST({O._year('earliest_cr_line')} AS INTEGER)) * 12
       + ({O._month('issue_d')} - {O._month('earliest_cr_line')}) AS SMALLINT) AS credit_history_months
FROM raw_loans""")


@register("p7_drop_raw_dates", P7_SQL)
def p7_drop_raw_dates(spark, d):
    return CL.parse_dates(raw(spark, d))


@lru_cache(maxsize=1)
def _feature_numeric_names() -> tuple:
    # the feature table's numeric columns, by construction of the fixture
    nums = ["loan_amnt", "term", "annual_inc", "dti", "revol_bal", "revol_util", "inq_last_6mths", "delinq_2yrs",
            "open_acc", "total_acc", "total_rev_hi_lim", "tot_cur_bal", "pub_rec", "mths_since_last_delinq",
            "mths_since_last_record", "tax_liens", "inq_last_12m", "num_accts_ever_120_pd", "emp_length_num",
            "issue_month", "credit_history_months", "home_ownership_enc", "verification_status_enc",
            "application_type_enc", "initial_list_status_enc"] + FE.FEATURE_NAMES
    return tuple(nums)


P10_SQL = sql_from("features", "SELECT loan_id, "
                   + ", ".join(f"TRY_CAST({c} AS FLOAT) AS {c}" for c in _feature_numeric_names())
                   + ", CAST(purpose AS VARCHAR) AS purpose, CAST(addr_state AS VARCHAR) AS addr_state FROM features")


@register("p10_model_types", P10_SQL)
def p10_model_types(spark, d):
    f = C.drop_non_features(features(spark, d))
    num, cat = C.split_feature_types(f, exclude=("loan_id",))
    return C.cast_model_types(f, num, cat)


P11_COLS = [c for c in K.FLOAT32_COLUMNS if c in O.RAW_NUMERIC]
P11_SQL = sql_from("raw_loans", "SELECT * REPLACE (" + ", ".join(f"TRY_CAST({c} AS FLOAT) AS {c}" for c in P11_COLS)
                   + ") FROM raw_loans")


@register("p11_downcast_float32", P11_SQL)
def p11_downcast_float32(spark, d):
    return C.downcast_float32(raw(spark, d))


def _safe_sql(c, dflt):
    return f"coalesce(CASE WHEN isnan(CAST({c} AS DOUBLE)) THEN NULL ELSE CAST({c} AS DOUBLE) END, {float(dflt)})"


P13_SQL = sql_from("raw_loans", "SELECT loan_id, " + ", ".join(
    f"{_safe_sql(c, v)} AS {c}_safe" for c, v in K.POLICY_INPUT_DEFAULTS.items()) + " FROM raw_loans")


@register("p13_safe_lookup", P13_SQL)
def p13_safe_lookup(spark, d):
    r = SC.safe_inputs(raw(spark, d))
    return r.select("loan_id", *[f"{c}_safe" for c in K.POLICY_INPUT_DEFAULTS])


# ---------------------------------------------------------------------------
# filters
# ---------------------------------------------------------------------------
TARGET_SQL = ("CAST(CASE WHEN loan_status IN ('Charged Off', 'Default') THEN 1 "
              "WHEN loan_status IN ('Fully Paid') THEN 0 END AS TINYINT)")


@register("f1_target_encoding", sql_from("raw_loans", f"SELECT loan_id, loan_status, {TARGET_SQL} AS target FROM raw_loans"))
def f1_target_encoding(spark, d):
    return CL.encode_target(raw(spark, d)).select("loan_id", "loan_status", "target")


@register("f2_resolved_loans", sql_from("raw_loans", f"""SELECT * EXCLUDE (loan_status), {TARGET_SQL} AS target
FROM raw_loans WHERE loan_status IN ('Charged Off', 'Default', 'Fully Paid')"""))
def f2_resolved_loans(spark, d):
    return CL.keep_resolved(CL.encode_target(raw(spark, d)))


@register("f3_drop_null_target", sql_from("features", "SELECT loan_id, target FROM features WHERE target IS NOT NULL"))
def f3_drop_null_target(spark, d):
    return resolved(spark, d).where(F.col("target").isNotNull()).select("loan_id", "target")


SPLIT_SQL = (f"CASE WHEN issue_year <= {K.FIXTURE_TRAIN_MAX_YEAR} THEN 'train' WHEN issue_year = {K.FIXTURE_VAL_YEAR} THEN 'val' "
             f"WHEN issue_year = {K.FIXTURE_TEST_YEAR} THEN 'test' END")


@register("f4_out_of_time_split", sql_from("features", f"SELECT loan_id, issue_year, {SPLIT_SQL} AS split FROM features"))
def f4_out_of_time_split(spark, d):
    return SP.with_split(resolved(spark, d), **K.FIXTURE_SPLIT).select("loan_id", "issue_year", "split")


@register("f5_cohort_year", sql_from("features", f"SELECT loan_id, issue_year, target FROM features WHERE issue_year = {K.FIXTURE_TEST_YEAR}"))
def f5_cohort_year(spark, d):
    return SP.cohort(resolved(spark, d), K.FIXTURE_TEST_YEAR).select("loan_id", "issue_year", "target")


@register("f6_classify_threshold", sql_from("scored", "SELECT loan_id, probability_of_default >= 0.22 AS predicted_default FROM scored"))
def f6_classify_threshold(spark, d):
    return scored(spark, d).select("loan_id", (F.col("probability_of_default") >= 0.22).alias("predicted_default"))


@register("f7_class_counts", sql_from("scored", """SELECT split, count(*) FILTER (WHERE target = 1) AS positives,
  count(*) FILTER (WHERE target = 0) AS negatives FROM scored GROUP BY split"""))
def f7_class_counts(spark, d):
    return scored(spark, d).groupBy("split").agg(F.count_if(F.col("target") == 1).alias("positives"),
                                                 F.count_if(F.col("target") == 0).alias("negatives"))


# ---------------------------------------------------------------------------
# joins
# ---------------------------------------------------------------------------
@register("j1_keyed_concat", sql_from("scored", f"""SELECT f.loan_id, f.target, f.loan_amnt, s.probability_of_default, s.risk_tier
FROM features f JOIN scored s ON f.loan_id = s.loan_id WHERE f.issue_year = {K.FIXTURE_TEST_YEAR}"""))
def j1_keyed_concat(spark, d):
    feats = score_features(spark, d)
    f = feats.where(F.col("issue_year") == K.FIXTURE_TEST_YEAR).select("loan_id", "target", "loan_amnt")
    s = SC.score_batch(SC.with_formula_pd(SP.with_split(feats, **K.FIXTURE_SPLIT))).select("loan_id", "probability_of_default", "risk_tier")
    return f.join(s, "loan_id")


RAW_COLUMN_NAMES = ["id", "member_id", "url", "policy_code", "loan_id", "loan_status", "loan_amnt", "term",
                    "emp_length", "emp_title", "issue_d", "earliest_cr_line", "last_credit_pull_d", "home_ownership",
                    "verification_status", "application_type", "initial_list_status", "purpose", "addr_state",
                    "annual_inc", "dti", "revol_bal", "revol_util", "inq_last_6mths", "delinq_2yrs", "open_acc",
                    "total_acc", "total_rev_hi_lim", "tot_cur_bal", "pub_rec", "mths_since_last_delinq",
                    "mths_since_last_record", "tax_liens", "inq_last_12m", "num_accts_ever_120_pd", "il_util",
                    "grade", "int_rate", "total_pymnt", "recoveries", "annual_inc_joint", "sec_app_open_acc"]

LEAK_PRESENT = [c for c in LK.leakage_columns() if c in RAW_COLUMN_NAMES]
_TARGET_SQL = ("CASE WHEN loan_status IN (" + ", ".join(f"'{x}'" for x in K.DEFAULT_STATUSES) + ") THEN 1 WHEN loan_status IN ("
               + ", ".join(f"'{x}'" for x in K.NON_DEFAULT_STATUSES) + ") THEN 0 END")
_SHARE_SQL = "count(CASE WHEN t = {k} THEN {c} END) / nullif(count(CASE WHEN t = {k} THEN 1 END), 0)"
J3_SQL = (W("raw_loans") + f", r AS (SELECT *, {_TARGET_SQL} AS t FROM raw_loans)\n"
          + "SELECT *, abs(share_default - share_paid) AS gap FROM (" + " UNION ALL ".join(
              f"SELECT '{cat}' AS category, '{c}' AS column, count({c}) AS n_values, {_SHARE_SQL.format(k=1, c=c)} AS share_default, "
              f"{_SHARE_SQL.format(k=0, c=c)} AS share_paid FROM r" for c, cat, _, _, _ in LK.registry_rows() if c in LEAK_PRESENT) + ")")


@register("j3_leakage_detection", J3_SQL)
def j3_leakage_detection(spark, d):
    """Registered columns present, with the share of defaults and of paid loans that have a value in them."""
    return LK.leakage_by_class(raw(spark, d), CL.target_expr())


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


J4_SQL = W("raw_loans") + " UNION ALL ".join(
    f"SELECT '{c}' AS column, '{cat}' AS category, {_quoted(desc)} AS description, {_quoted(risk)} AS risk, count({c}) AS n_values FROM raw_loans"
    for c, cat, desc, risk, _ in LK.registry_rows() if c in LEAK_PRESENT)


@register("j4_leakage_report", J4_SQL)
def j4_leakage_report(spark, d):
    """Registry rows for the leakage columns present, with their non-null counts."""
    r = raw(spark, d)
    present = [c for c in LK.leakage_columns() if c in r.columns]
    counts = r.agg(*[F.count(c).alias(c) for c in present])
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_values")) for c in present])
    long = counts.select(F.inline(arr))
    return long.join(F.broadcast(LK.leakage_report(spark)), "column").select("column", "category", "description", "risk", "n_values")


@register("j5_scalar_broadcast", W("cleaned") + """SELECT p.loan_id, p.annual_inc, m.annual_inc AS annual_inc_median,
  coalesce(p.annual_inc, m.annual_inc) AS annual_inc_filled FROM prepared p, med m""")
def j5_scalar_broadcast(spark, d):
    p = prepared_columns(spark, d, ["loan_id", "annual_inc"])
    stats = CL.fit_statistics(p, median_cols=["annual_inc"], cap_cols=[])
    m = stats.medians["annual_inc"]
    return p.select("loan_id", "annual_inc", F.lit(m).alias("annual_inc_median"),
                    F.coalesce("annual_inc", F.lit(m)).alias("annual_inc_filled"))


# ---------------------------------------------------------------------------
# aggregations
# ---------------------------------------------------------------------------
@register("a1_count_by_target", W("cleaned") + "SELECT target, count(*) AS n FROM cleaned GROUP BY target")
def a1_count_by_target(spark, d):
    return target_distribution(resolved(spark, d))


A2_SQL = W("raw_loans") + f"""SELECT raw_rows, cleaned_rows, raw_rows - cleaned_rows AS rows_removed,
  round((raw_rows - cleaned_rows) / raw_rows * 100, 1) AS rows_removed_pct, default_count, non_default_count,
  round(default_count / cleaned_rows * 100, 2) AS default_rate_pct
FROM (SELECT count(*) AS raw_rows,
  count(*) FILTER (WHERE loan_status IN ('Charged Off', 'Default', 'Fully Paid')) AS cleaned_rows,
  count(*) FILTER (WHERE {TARGET_SQL} = 1) AS default_count,
  count(*) FILTER (WHERE {TARGET_SQL} = 0) AS non_default_count FROM raw_loans)"""


@register("a2_cleaning_stats", A2_SQL)
def a2_cleaning_stats(spark, d):
    return cleaning_statistics(raw(spark, d))


A3_SQL = W("prepared") + " UNION ALL ".join(
    f"SELECT '{c}' AS column, quantile_cont({c}, 0.5) AS median FROM prepared" for c in O.MEDIAN_COLS)
A4_SQL = W("cleaned") + " UNION ALL ".join(
    f"SELECT '{c}' AS column, k.{c} AS cap FROM cap k" for c in O.CAP_COLS)


@register("a3_medians", A3_SQL)
def a3_medians(spark, d):
    p = prepared_columns(spark, d, O.MEDIAN_COLS)
    return CL.fit_statistics_frame(p, cap_cols=[]).select("column", "median")


@register("a4_cap_quantiles", A4_SQL)
def a4_cap_quantiles(spark, d):
    p = prepared_columns(spark, d, O.CAP_COLS)
    return CL.fit_statistics_frame(p, median_cols=[c for c in O.MEDIAN_COLS if c in O.CAP_COLS]).select("column", "cap")


A5_SQL = W("raw_loans") + "SELECT " + ", ".join(f"count(*) - count({c}) AS {c}" for c in RAW_COLUMN_NAMES) + " FROM raw_loans"


@register("a5_null_counts", A5_SQL)
def a5_null_counts(spark, d):
    from pdforge.operators.stats import null_counts
    return null_counts(raw(spark, d))


@register("a6_default_rate_by_year", W("features") + """SELECT issue_year, count(*) AS loans,
  CAST(sum(CAST(target AS BIGINT)) AS DOUBLE) / count(target) AS default_rate FROM features GROUP BY issue_year""")
def a6_default_rate_by_year(spark, d):
    return PF.default_rate_by_year(resolved(spark, d))


@register("a7_distinct_years", W("features") + "SELECT DISTINCT issue_year FROM features")
def a7_distinct_years(spark, d):
    return PF.distinct_years(resolved(spark, d))


TIER_RANK_SQL = "CASE risk_tier " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(K.TIER_ORDER)) + " END"
A8_SQL = W("scored") + f"""SELECT risk_tier, {TIER_RANK_SQL} AS tier_rank, count(probability_of_default) AS count,
  CAST({O.dsum('probability_of_default')} AS DOUBLE) / count(probability_of_default) AS avg_pd,
  CAST(sum(CAST(target AS BIGINT)) AS DOUBLE) / count(target) AS actual_default_rate
FROM scored WHERE split = 'test' GROUP BY risk_tier"""


@register("a8_tier_validation", A8_SQL)
def a8_tier_validation(spark, d):
    return PF.tier_validation(test_scored(spark, d))


def _portfolio_sql(where: str) -> str:
    return W("scored") + f"""SELECT risk_tier, loan_count,
  CAST(round(exposure, 2) AS DOUBLE) AS total_exposure,
  CAST(pd_sum AS DOUBLE) / pd_n AS avg_pd,
  CAST(defaults AS DOUBLE) / target_n AS actual_default_rate,
  CAST(round(el, 4) AS DOUBLE) AS total_expected_loss,
  approve_count, refer_count, deny_count,
  round(loan_count / sum(loan_count) OVER () * 100, 1) AS pct_of_portfolio,
  round(CAST(exposure AS DOUBLE) / CAST(sum(exposure) OVER () AS DOUBLE) * 100, 1) AS pct_of_exposure
FROM (SELECT risk_tier, count(loan_amnt) AS loan_count, {O.dsum('ead')} AS exposure,
        {O.dsum('probability_of_default')} AS pd_sum, count(probability_of_default) AS pd_n,
        sum(CAST(target AS BIGINT)) AS defaults, count(target) AS target_n,
        {O.dsum('expected_loss', 6)} AS el,
        count(*) FILTER (WHERE policy_decision = 'Approve') AS approve_count,
        count(*) FILTER (WHERE policy_decision = 'Refer') AS refer_count,
        count(*) FILTER (WHERE policy_decision = 'Deny') AS deny_count
      FROM losses {where} GROUP BY risk_tier)"""


@register("a9_portfolio_summary", _portfolio_sql(""))
def a9_portfolio_summary(spark, d):
    return PF.portfolio_summary(scored(spark, d))


A10_SQL = "SELECT risk_tier, pct_of_portfolio, pct_of_exposure FROM (" + _portfolio_sql("") + ")"


@register("a10_portfolio_shares", A10_SQL)
def a10_portfolio_shares(spark, d):
    return PF.portfolio_summary(scored(spark, d)).select("risk_tier", "pct_of_portfolio", "pct_of_exposure")


A11_SQL = W("scored") + f"""SELECT loans, CAST(round(e, 2) AS DOUBLE) AS total_exposure,
  CAST(round(l, 4) AS DOUBLE) AS total_expected_loss,
  round(CAST(l AS DOUBLE) / CAST(e AS DOUBLE) * 100, 4) AS el_rate_pct
FROM (SELECT {O.dsum('ead')} AS e, {O.dsum('expected_loss', 6)} AS l, count(*) AS loans FROM losses)"""


@register("a11_portfolio_totals", A11_SQL)
def a11_portfolio_totals(spark, d):
    return PF.portfolio_totals(scored(spark, d))


@register("a12_split_sizes", W("features") + f"""SELECT split, count(*) AS rows,
  CAST(sum(CAST(target AS BIGINT)) AS DOUBLE) / count(target) AS default_rate
FROM (SELECT *, {SPLIT_SQL} AS split FROM features WHERE target IS NOT NULL) WHERE split IS NOT NULL GROUP BY split""")
def a12_split_sizes(spark, d):
    return PF.split_sizes(SP.with_split(resolved(spark, d), **K.FIXTURE_SPLIT))


@register("a13_class_ratio", W("features") + f"""SELECT CAST(sum(1 - CAST(target AS BIGINT)) AS BIGINT) AS negatives,
  CAST(sum(CAST(target AS BIGINT)) AS BIGINT) AS positives,
  CAST(sum(1 - CAST(target AS BIGINT)) AS DOUBLE) / sum(CAST(target AS BIGINT)) AS neg_pos_ratio
FROM features WHERE issue_year <= {K.FIXTURE_TRAIN_MAX_YEAR}""")
def a13_class_ratio(spark, d):
    f = SP.with_split(resolved(spark, d).where(SP.split_predicate("train", **K.FIXTURE_SPLIT)), **K.FIXTURE_SPLIT)
    return PF.class_ratio(f)


A16_SQL = W("scored") + """, t AS (SELECT probability_of_default AS p FROM scored WHERE split = 'test'),
rng AS (SELECT min(p) AS lo, max(p) AS hi FROM t),
b AS (SELECT CAST(least(floor((p - lo) / ((hi - lo) / 40)), 39) AS INTEGER) AS bin, count(*) AS count
      FROM t, rng WHERE p IS NOT NULL GROUP BY 1)
SELECT g.bin, lo + g.bin * (hi - lo) / 40 AS bin_start, coalesce(b.count, 0) AS count
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(40)) g CROSS JOIN rng LEFT JOIN b ON g.bin = b.bin"""


@register("a16_pd_histogram", A16_SQL)
def a16_pd_histogram(spark, d):
    return PF.pd_histogram(test_scored(spark, d))


# continuation: scalar functions, windows, metrics, attribution, jobs
from pdforge.plans import catalog_scoring  # noqa: E402,F401
from pdforge.plans import catalog_models  # noqa: E402,F401
