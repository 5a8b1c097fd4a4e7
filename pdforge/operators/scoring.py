"""Scoring operators: batch scoring (B2), decision records (B1), template
rows (A14), applicant overrides (P12), application scoring (B4), scenarios
(B5) and the held-out sample (B3).

Scoring is a narrow transformation: one projection per row, no shuffle, no
UDF. The only aggregate is the template row (one pass, partial aggregation).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pdforge import constants as K
from pdforge.functions import risk as R
from pdforge.functions.encoding import safe_value
from pdforge.functions.features import add_features
from pdforge.operators.splits import deterministic_sample

APPLICATION_SCHEMA = T.StructType([
    T.StructField("application_id", T.LongType()),
    T.StructField("loan_amnt", T.DoubleType()),
    T.StructField("term", T.IntegerType()),
    T.StructField("annual_inc", T.DoubleType()),
    T.StructField("dti", T.DoubleType()),
    T.StructField("revol_bal", T.DoubleType()),
    T.StructField("revol_util", T.DoubleType()),
    T.StructField("delinq_2yrs", T.IntegerType()),
])


def with_formula_pd(df: DataFrame, pd_col: str = "pd") -> DataFrame:
    """Attach the closed-form PD (needs dti, delinq_2yrs, loan_pct_of_income)."""
    return df.withColumn(pd_col, R.formula_pd())


def score_batch(df: DataFrame, pd_col: str = "pd") -> DataFrame:
    """B2: PD (4 places), tier, grade, action and policy decision per row.

    Every input column is kept, so the result stays keyed (J1: no positional
    concat). Missing policy inputs use the single-application defaults.
    """
    x = R.policy_inputs()
    pct = R.loan_pct_income_policy(x["loan_amnt"], x["annual_inc"])
    denied = R.any_rule(F.col(pd_col), x["dti"], x["inq_last_6mths"], x["delinq_2yrs"], pct)
    return df.withColumns({
        "probability_of_default": R.pd_rounded(pd_col),
        "risk_tier": R.risk_tier(pd_col),
        "credit_grade": R._tier_field(R.clamp_pd(pd_col), 2),
        "recommended_action": R._tier_field(R.clamp_pd(pd_col), 5),
        "policy_decision": R.decision_from_flag(denied, F.col(pd_col)),
    })


def decision_records(df: DataFrame, pd_col: str = "pd", threshold: float = 0.5,
                     model_name: str = "formula") -> DataFrame:
    """B1: the nested decision per row (bucket struct, policy struct, flags)."""
    return df.select(
        *[c for c in ("loan_id", "application_id") if c in df.columns],
        F.lit(model_name).alias("model"),
        F.lit(round(threshold, 4)).alias("threshold"),
        R.pd_rounded(pd_col).alias("probability_of_default"),
        (F.col(pd_col) >= threshold).alias("predicted_default"),
        R.risk_bucket(pd_col).alias("risk_bucket"),
        R.policy_decision(F.col(pd_col)).alias("policy_decision"),
    )


def most_frequent(df: DataFrame, c: str):
    """Mode of a column (ties -> smallest value): a distributed count, then a top-1
    (TakeOrdered keeps one row per task), so no task ever holds all distinct values."""
    row = (df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
           .orderBy(F.desc("_n"), F.asc(c)).limit(1).collect())
    return row[0][c] if row else None


def template_row(features: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """One row — median of each numeric column, most frequent value of each text column.

    Medians are exact and distributed (``stats.exact_quantiles``); modes are a
    grouped count plus top-1 (ties -> smallest value).
    """
    from pdforge.operators.stats import exact_quantiles

    spark = features.sparkSession
    values = {}
    if numeric:
        for r in exact_quantiles(features, numeric, [0.5]).collect():  # one row per column
            values[r["column"]] = r["value"]
    for c in categorical:
        values[c] = most_frequent(features, c)
    fields = [T.StructField(c, T.DoubleType() if c in numeric else T.StringType()) for c in numeric + categorical]
    return spark.createDataFrame([tuple(values.get(c) for c in numeric + categorical)], T.StructType(fields))


def override_template(apps: DataFrame, template: DataFrame | dict, fields=K.APPLICATION_FIELDS) -> DataFrame:
    """Each application takes the template row, with its own values where given.

    The template is a single row (bounded), read once and inlined as literals,
    so the applications stream through a projection with no join.
    """
    types = {}
    if isinstance(template, dict):
        t = template
    else:
        t = template.first().asDict()  # the single template row
        types = {f.name: f.dataType for f in template.schema.fields}
    out = [F.col(c) for c in apps.columns if c not in fields]
    for c in fields:
        if c in apps.columns:
            out.append(F.coalesce(F.col(c).cast("double"), F.lit(t.get(c)).cast("double")).alias(c))
        else:
            out.append(F.lit(t.get(c)).cast("double").alias(c))
    for c, v in t.items():
        if c not in fields and c not in apps.columns:
            lit = F.lit(v).cast(types[c]) if c in types else F.lit(v)
            out.append(lit.alias(c))
    return apps.select(*out)


def score_applications(apps: DataFrame, template, pd_fn=None) -> DataFrame:
    """Applications -> template overrides -> features -> PD -> decision columns.

    ``pd_fn`` gives the PD of a model for the rows, as a column or as the rows with a column ``pd``.
    """
    from pdforge.functions.features import FEATURE_NAMES
    rows = override_template(apps, template)
    rows = add_features(rows.drop(*[c for c in FEATURE_NAMES if c in rows.columns]))
    pd = pd_fn(rows) if pd_fn else R.formula_pd()
    return score_batch(pd if isinstance(pd, DataFrame) else rows.withColumn("pd", pd))


def scenario_frame(spark: SparkSession) -> DataFrame:
    """The four what-if applicants (a fixed 4-row frame)."""
    rows = [(i + 1, name, *vals) for i, (name, *vals) in enumerate(K.SCENARIOS)]
    return spark.createDataFrame(rows, "application_id long, scenario string, loan_amnt double, "
                                       "term int, annual_inc double, dti double, revol_bal double, "
                                       "revol_util double, delinq_2yrs int")


def applications_from_loans(raw: DataFrame, year: int | None = None) -> DataFrame:
    """Application-form rows taken from raw loans (id, 7 form fields), optionally one issue year."""
    from pdforge.functions import parsing
    rows = raw if year is None else raw.where(parsing.issue_year("issue_d") == year)
    return rows.select(F.col("loan_id").alias("application_id"), F.col("loan_amnt").cast("double"),
                       parsing.parse_term("term").cast("int").alias("term"), F.col("annual_inc").cast("double"),
                       F.col("dti").cast("double"), F.col("revol_bal").cast("double"),
                       F.col("revol_util").cast("double"), F.col("delinq_2yrs").cast("int"))


def template_columns(features: DataFrame) -> tuple[list[str], list[str]]:
    """Numeric and text columns a template row carries (non-feature columns dropped)."""
    from pdforge.operators.columns import split_feature_types
    drop = set(K.NON_FEATURE_COLUMNS) | {"loan_id", "split", "pd"}
    num, cat = split_feature_types(features.drop(*[c for c in drop if c in features.columns]), exclude=())
    return num, cat


def held_out_sample(features: DataFrame, n: int = 1, year: int = K.TEST_YEAR,
                    seed: int = K.RANDOM_SEED) -> DataFrame:
    """N seeded rows of one cohort year, non-feature columns dropped."""
    rows = features.where(F.col("issue_year") == year)
    rows = deterministic_sample(rows, n, key="loan_id", seed=seed)
    return rows.drop(*[c for c in K.NON_FEATURE_COLUMNS if c in rows.columns])


def safe_inputs(df: DataFrame) -> DataFrame:
    """Policy inputs with defaults (null / NaN / absent)."""
    out = {}
    for c, dflt in K.POLICY_INPUT_DEFAULTS.items():
        out[f"{c}_safe"] = safe_value(F.col(c), dflt) if c in df.columns else F.lit(float(dflt))
    return df.withColumns(out)
