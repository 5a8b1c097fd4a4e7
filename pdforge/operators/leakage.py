"""Leakage registry as a small DataFrame, detection by semi-join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pdforge.constants import LEAKAGE_CATEGORIES

REGISTRY_SCHEMA = "column string, category string, description string, risk string, ordinal int"


def leakage_columns() -> list[str]:
    return [c for _, (_, _, cols) in LEAKAGE_CATEGORIES.items() for c in cols]


def registry_rows() -> list[tuple]:
    rows, i = [], 0
    for cat, (desc, risk, cols) in LEAKAGE_CATEGORIES.items():
        for c in cols:
            rows.append((c, cat, desc, risk, i))
            i += 1
    return rows


def leakage_report(spark: SparkSession) -> DataFrame:
    """One row per registered column (40 rows, fixed by the registry)."""
    return spark.createDataFrame(registry_rows(), REGISTRY_SCHEMA)


def column_names_frame(spark: SparkSession, columns: list[str]) -> DataFrame:
    return spark.createDataFrame([(c,) for c in columns], "column string")


def detect_leakage(df: DataFrame) -> DataFrame:
    """Registry semi-joined with the frame's columns, per category.

    Result: (category, n_columns, columns) plus an overall row is available
    through ``leakage_summary``.
    """
    spark = df.sparkSession
    reg = leakage_report(spark)
    cols = column_names_frame(spark, df.columns)
    found = reg.join(F.broadcast(cols), "column", "left_semi")
    return (found.groupBy("category")
            .agg(F.count(F.lit(1)).alias("n_columns"),
                 F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column"))),
                                          lambda s: s["column"]), ",").alias("columns")))


def leakage_by_class(df: DataFrame, target) -> DataFrame:
    """J3 over the rows: what each registered column that the table has tells of the outcome.

    (category, column, n_values, share_default, share_paid, gap): rows with a value, the share of rows with a value among
    defaults and among paid loans (null where there is no such loan), and the distance of the two. One aggregate over
    the registered columns alone, joined with the registry of 40 rows.
    """
    present = [c for c in leakage_columns() if c in df.columns]
    reg = leakage_report(df.sparkSession).select("column", "category", "ordinal")
    if not present:
        return reg.limit(0).select("category", "column", F.lit(0).cast("long").alias("n_values"), F.lit(0.0).alias("share_default"),
                                   F.lit(0.0).alias("share_paid"), F.lit(0.0).alias("gap"))
    t = df.select(target.alias("_target"), *present)
    held = lambda c, k: F.count(F.when((F.col("_target") == k) & F.col(c).isNotNull(), 1))
    one = t.agg(*[F.count(F.when(F.col("_target") == k, 1)).alias(f"n{k}") for k in (0, 1)],
                *[F.struct(F.count(c).alias("n"), held(c, 0).alias("c0"), held(c, 1).alias("c1")).alias(f"s_{c}") for c in present])
    share = lambda c, k: F.when(F.col(f"n{k}") > 0, F.col(f"s_{c}.c{k}") / F.col(f"n{k}"))
    long = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"s_{c}.n").alias("n_values"), share(c, 1).alias("share_default"),
                                                  share(c, 0).alias("share_paid")) for c in present])))
    return long.join(F.broadcast(reg), "column").select("category", "column", "n_values", "share_default", "share_paid",
                                                        F.abs(F.col("share_default") - F.col("share_paid")).alias("gap"))


def leakage_summary(df: DataFrame) -> DataFrame:
    """One row: total leakage columns found, categories hit, clean flag."""
    by_cat = detect_leakage(df)
    return by_cat.agg(F.coalesce(F.sum("n_columns"), F.lit(0)).cast("bigint").alias("total_leakage"),
                      F.count(F.lit(1)).alias("n_categories"),
                      (F.coalesce(F.sum("n_columns"), F.lit(0)) == 0).alias("clean"))
