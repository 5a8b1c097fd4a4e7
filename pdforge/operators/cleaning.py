"""Cleaning operators: target, resolved-loan filter, parsing, imputation,
capping, encoding — and the fitted statistics they need.

Fitted statistics (54 medians, 8 caps) are exact order statistics found by
sketching all columns at once (``stats.values_at_ranks``); the resulting scalars (one per column, a bounded set) are turned into literals so
that applying them is a single projection with no join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pdforge import constants as K
from pdforge.functions import encoding, parsing
from pdforge.operators import columns as C
from pdforge.operators.stats import interpolation_ranks, sketch_columns, values_at_ranks

RESOLVED_STATUSES = K.DEFAULT_STATUSES + K.NON_DEFAULT_STATUSES


def target_expr(status="loan_status") -> Column:
    """Charged Off / Default -> 1, Fully Paid -> 0, anything else -> null (tinyint)."""
    s = F.col(status)
    return (F.when(s.isin(*K.DEFAULT_STATUSES), F.lit(1))
            .when(s.isin(*K.NON_DEFAULT_STATUSES), F.lit(0))
            .otherwise(F.lit(None))).cast("tinyint")


def encode_target(df: DataFrame) -> DataFrame:
    return df.withColumn("target", target_expr())


def keep_resolved(df: DataFrame) -> DataFrame:
    """resolved loans only, status dropped.

    The plain ``IN`` on the source column is written first so it reaches the
    Parquet scan as a pushed filter (a filter on the derived target would not).
    """
    out = df.where(F.col("loan_status").isin(*RESOLVED_STATUSES))
    if "target" not in out.columns:
        out = encode_target(out)
    return out.where(F.col("target").isNotNull()).drop("loan_status")


def parse_strings(df: DataFrame) -> DataFrame:
    """X1 + X2: term -> smallint, emp_length -> emp_length_num (source dropped)."""
    return (df.withColumns({"term": parsing.parse_term("term"),
                            "emp_length_num": parsing.parse_emp_length("emp_length")})
            .drop("emp_length"))


def parse_dates(df: DataFrame) -> DataFrame:
    """X3 + X4 + P7: year, month, credit-history months; raw date columns dropped."""
    out = df.withColumns({
        "issue_year": parsing.issue_year("issue_d"),
        "issue_month": parsing.issue_month("issue_d"),
        "credit_history_months": parsing.credit_history_months("issue_d", "earliest_cr_line"),
    })
    return C.drop_raw_dates(out)


#: Columns that the cleaning parses, fills or caps.
REQUIRED_COLUMNS = list(dict.fromkeys(
    ["loan_status", "term", "emp_length", "issue_d", "earliest_cr_line"] + K.NEVER_HAPPENED_COLUMNS
    + K.ZERO_FILL_COLUMNS + K.MEDIAN_FILL_COLUMNS + K.CAP_COLUMNS))


def require_columns(raw: DataFrame, columns=None) -> DataFrame:
    """``raw`` itself, or one error that names every column the cleaning would miss."""
    missing = [c for c in (REQUIRED_COLUMNS if columns is None else columns) if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    return raw


def prepare_for_imputation(raw: DataFrame) -> DataFrame:
    """Stages before the first global statistic: drop, target, filter, de-leak, parse."""
    raw_cols = list(raw.columns)
    df = C.drop_static_columns(raw)
    df = keep_resolved(encode_target(df))
    df = C.drop_leakage_columns(df)
    df = parse_strings(df)
    df = parse_dates(df)
    return C.drop_joint_columns(df, raw_cols)


@dataclass
class CleaningStats:
    """Fitted medians (imputation) and caps (0.995 quantile of imputed values)."""
    medians: dict[str, float | None] = field(default_factory=dict)
    caps: dict[str, float | None] = field(default_factory=dict)

    def to_frame(self, spark) -> DataFrame:
        rows = [(c, self.medians.get(c), self.caps.get(c))
                for c in dict.fromkeys(list(self.medians) + list(self.caps))]
        return spark.createDataFrame(rows, "column string, median double, cap double")

    @classmethod
    def from_frame(cls, df: DataFrame) -> "CleaningStats":
        rows = df.collect()  # one row per column: bounded by the column lists
        return cls({r["column"]: r["median"] for r in rows}, {r["column"]: r["cap"] for r in rows})


def fit_statistics(df: DataFrame, median_cols=None, cap_cols=None, cap_q: float = K.CAP_QUANTILE,
                   **kw) -> CleaningStats:
    """Medians of the median columns, then caps at ``cap_q`` of the imputed values.

    One sketch pass over all columns, one count pass and one pass over the values
    near the wanted ranks (``stats.values_at_ranks``); no column is unpivoted. A
    cap's rank counts the imputed rows too: they all sit at the median, so the
    imputed column's value at a rank is one of two values of the column itself,
    or the median.
    """
    median_cols = [c for c in (K.MEDIAN_FILL_COLUMNS if median_cols is None else median_cols) if c in df.columns]
    cap_cols = [c for c in (K.CAP_COLUMNS if cap_cols is None else cap_cols) if c in df.columns]
    all_cols = list(dict.fromkeys(median_cols + cap_cols))
    if not all_cols:
        return CleaningStats({}, {})
    sketches = sketch_columns(df, all_cols, **{k: v for k, v in kw.items() if k != "finish_rows"})
    ranks = {c: set() for c in all_cols}
    med_at, cap_at = {}, {}
    for c in median_cols:
        if sketches[c].n:
            med_at[c] = interpolation_ranks(sketches[c].n, 0.5)
            ranks[c] |= set(med_at[c][1:])
    for c in cap_cols:
        n = sketches[c].n
        if n:
            filled = sketches[c].rows - n if c in median_cols else 0
            cap_at[c] = (filled, *interpolation_ranks(n + filled, cap_q))
            ranks[c] |= {x for r in cap_at[c][2:] for x in (r, r - filled) if 0 <= x < n}
    found = values_at_ranks(df, ranks, sketches, **kw)

    def between(h, lo, low, high):
        return low + (h - lo) * (high - low)

    medians = {c: between(med_at[c][0], med_at[c][1], found[(c, med_at[c][1])], found[(c, med_at[c][2])])
               if c in med_at else None for c in median_cols}

    def imputed_at(c, r, filled):
        if not filled:
            return found[(c, r)]
        m, before, after = medians[c], found.get((c, r)), found.get((c, r - filled))
        if before is not None and before < m:
            return before
        return after if after is not None and after > m else m

    caps = {c: None for c in cap_cols}
    for c, (filled, h, lo, hi) in cap_at.items():
        caps[c] = between(h, lo, imputed_at(c, lo, filled), imputed_at(c, hi, filled))
    return CleaningStats(medians, caps)


def fit_statistics_frame(df: DataFrame, **kw) -> DataFrame:
    """(column, median, cap) as a DataFrame (one row per fitted column)."""
    return fit_statistics(df, **kw).to_frame(df.sparkSession)


def impute_fixed(df: DataFrame) -> DataFrame:
    """X5 + X6: 'never happened' -> 999, count columns -> 0 (nulls only, NaN kept)."""
    wide = lambda c: T.IntegerType() if isinstance(df.schema[c].dataType, T.ByteType) else df.schema[c].dataType
    fills = {c: F.coalesce(F.col(c).cast(wide(c)), F.lit(K.NEVER_HAPPENED_FILL).cast(wide(c)))
             for c in K.NEVER_HAPPENED_COLUMNS if c in df.columns}
    fills.update({c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType))
                  for c in K.ZERO_FILL_COLUMNS if c in df.columns})
    return df.withColumns(fills) if fills else df


def _fractional_type(df: DataFrame, c: str):
    """Type of a column that can hold a fitted statistic: integers become double."""
    kind = df.schema[c].dataType
    return T.DoubleType() if isinstance(kind, T.IntegralType) else kind


def _fractional(df: DataFrame, c: str):
    return F.col(c).cast(_fractional_type(df, c))


def impute_medians(df: DataFrame, stats: CleaningStats) -> DataFrame:
    """Null -> fitted median (a column with no values stays null)."""
    fills = {c: F.coalesce(_fractional(df, c), F.lit(m).cast(_fractional_type(df, c)))
             for c, m in stats.medians.items() if c in df.columns and m is not None}
    return df.withColumns(fills) if fills else df


def cap_outliers(df: DataFrame, stats: CleaningStats) -> DataFrame:
    """Values above the fitted cap become the cap; null stays null."""
    caps = {c: F.when(F.col(c) > F.lit(q), F.lit(q).cast(_fractional_type(df, c))).otherwise(_fractional(df, c))
            for c, q in stats.caps.items() if c in df.columns and q is not None}
    return df.withColumns(caps) if caps else df


def encode_categoricals(df: DataFrame) -> DataFrame:
    """X9 + X10: four ordinal maps (sources dropped); purpose / addr_state stay text."""
    enc = {f"{c}_enc": encoding.ordinal_code(c, codes)
           for c, codes in K.ENCODED_CATEGORICALS.items() if c in df.columns}
    return df.withColumns(enc).drop(*[c for c in K.ENCODED_CATEGORICALS if c in df.columns])


def apply_cleaning(df: DataFrame, stats: CleaningStats) -> DataFrame:
    """Impute -> cap -> encode -> downcast, in the original order."""
    df = impute_fixed(df)
    df = impute_medians(df, stats)
    df = cap_outliers(df, stats)
    df = encode_categoricals(df)
    return C.downcast_float32(df)
