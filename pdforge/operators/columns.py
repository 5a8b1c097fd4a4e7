"""Column-set operators (projections). All are metadata-only plan changes:
Catalyst prunes the dropped columns out of the Parquet scan's ReadSchema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pdforge import constants as K
from pdforge.operators.leakage import leakage_columns


def drop_present(df: DataFrame, cols) -> DataFrame:
    present = [c for c in cols if c in df.columns]
    return df.drop(*present) if present else df


def drop_static_columns(df: DataFrame) -> DataFrame:
    """The eight identifier / constant / free-text columns."""
    return drop_present(df, K.DROP_COLUMNS)


def drop_leakage_columns(df: DataFrame) -> DataFrame:
    """Every registered leakage column that is present."""
    return drop_present(df, [c for c in leakage_columns() if c != "loan_status"])


def joint_columns(columns) -> list[str]:
    return [c for c in columns if c.startswith(K.JOINT_PREFIXES)]


def drop_joint_columns(df: DataFrame, raw_columns=None) -> DataFrame:
    """Joint / secondary applicant columns, found by prefix."""
    return drop_present(df, joint_columns(raw_columns or df.columns))


def all_null_columns(df: DataFrame) -> list[str]:
    """Columns with no non-null value: one global aggregate (partial per task)."""
    row = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if row[c] == 0]


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """P4."""
    return drop_present(df, all_null_columns(df))


def drop_temp_columns(df: DataFrame) -> DataFrame:
    """P5: helper columns whose names start with '_'."""
    return drop_present(df, [c for c in df.columns if c.startswith("_")])


def drop_non_features(df: DataFrame) -> DataFrame:
    """Text and split columns, tolerant of absence."""
    return drop_present(df, K.NON_FEATURE_COLUMNS)


def drop_raw_dates(df: DataFrame) -> DataFrame:
    """P7."""
    return drop_present(df, K.RAW_DATE_COLUMNS)


def split_feature_types(df: DataFrame, exclude=("target", "issue_year", "loan_id", "split")) \
        -> tuple[list[str], list[str]]:
    """Numeric vs categorical feature names, decided by Spark type."""
    num, cat = [], []
    for f in df.schema.fields:
        if f.name in exclude:
            continue
        if isinstance(f.dataType, T.NumericType):
            num.append(f.name)
        elif isinstance(f.dataType, (T.StringType, T.BooleanType)):
            cat.append(f.name)
    return num, cat


def align_features(df: DataFrame, features: list[str], keep=("loan_id",)) -> DataFrame:
    """Project to a frozen feature list; report every missing name at once."""
    missing = [c for c in features if c not in df.columns]
    if missing:
        more = "..." if len(missing) > 10 else ""
        raise ValueError(f"Missing required features: {missing[:10]}{more}")
    extra = [c for c in keep if c in df.columns and c not in features]
    return df.select(*extra, *features)


def cast_model_types(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """P10: numerics to float (bad -> null), categoricals to text."""
    return df.withColumns({**{c: F.col(c).try_cast("float") for c in numeric},
                           **{c: F.col(c).cast("string") for c in categorical}})


def downcast_float32(df: DataFrame) -> DataFrame:
    """The 21 listed float columns to float, non-strict."""
    return df.withColumns({c: F.col(c).try_cast("float") for c in K.FLOAT32_COLUMNS if c in df.columns})
