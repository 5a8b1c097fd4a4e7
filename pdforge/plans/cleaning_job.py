"""The cleaning job and the feature job as DataFrame plans.

Job shape: one scan -> projections/filters (pushed into the scan) -> one
written table of the wanted columns -> sketches, counts and near-rank values
for the fitted statistics -> one projection applying literals -> one global
null-count -> write. Features are a single extra projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pdforge import constants as K
from pdforge.functions.features import add_features
from pdforge.operators import cleaning as CL
from pdforge.operators import columns as C
from pdforge.session import compiled_methods, materialize


@dataclass
class CleaningResult:
    cleaned: DataFrame
    stats: CL.CleaningStats
    dropped_all_null: list


def run_cleaning(raw: DataFrame, fit_on: Column | None = None, drop_all_null: bool = True,
                 materialize_prepared: bool = True, columns: list | None = None, strict: bool = False,
                 **kw) -> CleaningResult:
    """B7 without the sink: returns the cleaned DataFrame and its fitted statistics.

    ``fit_on`` restricts the rows used to fit medians / caps (default: all
    resolved loans, as in the original; e.g. ``F.col('issue_year') <= 1999``
    fits on the training years only).

    ``columns`` names the prepared columns that the caller goes on to read: only
    these are derived, written, fitted and checked for nulls. A column's statistics
    depend on no other column, so the values are those of the full run.

    ``strict`` refuses a raw table that lacks a column to fill or cap; otherwise
    such a column is left out.
    """
    if strict:
        CL.require_columns(raw)
    prepared = CL.prepare_for_imputation(raw)
    if columns is not None:
        prepared = prepared.select(*[c for c in prepared.columns if c in set(columns)])
    if materialize_prepared:
        # one pass over the raw joins; stats, null check and the output all read this table
        with compiled_methods(raw.sparkSession):
            prepared = materialize(prepared, "prepared_loans")
    fit_rows = prepared.where(fit_on) if fit_on is not None else prepared
    fit_rows = CL.impute_fixed(fit_rows)
    stats = CL.fit_statistics(fit_rows, **kw)
    cleaned = CL.apply_cleaning(prepared, stats)
    dropped = []
    if drop_all_null:
        # imputation, capping and encoding never create nulls, so a cleaned column is
        # all-null exactly when its source is all-null and no median filled it
        src = C.all_null_columns(prepared)
        filled = set(K.NEVER_HAPPENED_COLUMNS) | set(K.ZERO_FILL_COLUMNS)
        dropped = [c for c in src if c in cleaned.columns and c not in filled and stats.medians.get(c) is None]
        cleaned = C.drop_present(cleaned, dropped)
    return CleaningResult(cleaned, stats, dropped)


def cleaned_loans(raw: DataFrame, **kw) -> DataFrame:
    return run_cleaning(raw, **kw).cleaned


def feature_table(raw: DataFrame, **kw) -> DataFrame:
    """Cleaned loans plus the ten features (temp columns dropped)."""
    return add_features(cleaned_loans(raw, **kw))


def cleaning_statistics(raw: DataFrame) -> DataFrame:
    """A2: one row of cleaning statistics, from a single aggregate over the raw rows."""
    resolved = F.col("loan_status").isin(*CL.RESOLVED_STATUSES)
    target = CL.target_expr()
    stats = raw.agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count(F.when(resolved, 1)).alias("cleaned_rows"),
        F.count(F.when(target == 1, 1)).alias("default_count"),
        F.count(F.when(target == 0, 1)).alias("non_default_count"),
    )
    return stats.select(
        "raw_rows", "cleaned_rows",
        (F.col("raw_rows") - F.col("cleaned_rows")).alias("rows_removed"),
        F.round((F.col("raw_rows") - F.col("cleaned_rows")) / F.col("raw_rows") * 100, 1)
        .alias("rows_removed_pct"),
        "default_count", "non_default_count",
        F.round(F.col("default_count") / F.col("cleaned_rows") * 100, 2).alias("default_rate_pct"),
    )


def target_distribution(cleaned: DataFrame) -> DataFrame:
    """A1: loans per target value, sorted."""
    return cleaned.groupBy("target").agg(F.count(F.lit(1)).alias("n")).orderBy("target")


__all__ = ["run_cleaning", "cleaned_loans", "feature_table", "cleaning_statistics",
           "target_distribution", "CleaningResult", "K"]


def write_cleaning_job(raw: DataFrame, out_path: str, stats_path: str | None = None,
                       partition_by: str | None = "issue_year", **kw) -> dict:
    """B7 with its sink: clean, write Parquet (partitioned by year), return statistics.

    Row and class counts come from one aggregate over the written table's
    ``target`` column (a columnar read of one field). ``Observation`` is not
    used: once a session has observed a query it holds a non-serializable
    manager that later breaks closures capturing the session (e.g. a logistic
    model's training summary). Fitted medians / caps are saved as a small
    table next to the output so scoring can reuse exactly these values.
    """
    res = run_cleaning(raw, **kw)
    w = res.cleaned.write.mode("overwrite")
    if partition_by and partition_by in res.cleaned.columns:
        w = w.partitionBy(partition_by)
    w.parquet(out_path)
    m = (raw.sparkSession.read.parquet(out_path)
         .agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("target") == 1, 1)).alias("defaults")).first())
    if stats_path:
        res.stats.to_frame(raw.sparkSession).coalesce(1).write.mode("overwrite").parquet(stats_path)
    raw_rows = raw.count()
    rows, defaults = m["rows"], m["defaults"]
    size = (raw.sparkSession.read.parquet(out_path).select(F.col("_metadata.file_path").alias("p"),
                                                          F.col("_metadata.file_size").alias("s"))
            .distinct().agg(F.sum("s")).first()[0] or 0)
    return {
        "raw_rows": raw_rows, "raw_columns": len(raw.columns),
        "cleaned_rows": rows, "cleaned_columns": len(res.cleaned.columns),
        "rows_removed": raw_rows - rows,
        "rows_removed_pct": round((raw_rows - rows) / raw_rows * 100, 1) if raw_rows else 0.0,
        "default_count": defaults, "non_default_count": rows - defaults,
        "default_rate_pct": round(defaults / rows * 100, 2) if rows else 0.0,
        "file_size_mb": round(size / 1024 ** 2, 1), "columns": res.cleaned.columns,
        "dropped_all_null": res.dropped_all_null,
    }


def write_feature_job(cleaned_path: str, out_path: str, spark=None, partition_by: str | None = "issue_year") -> dict:
    """B8 with its sink: read cleaned Parquet, add the ten features, write, return statistics."""
    from pyspark.sql import SparkSession

    from pdforge.functions.features import FEATURE_NAMES

    spark = spark or SparkSession.getActiveSession()
    feats = add_features(spark.read.parquet(cleaned_path))
    w = feats.write.mode("overwrite")
    if partition_by and partition_by in feats.columns:
        w = w.partitionBy(partition_by)
    w.parquet(out_path)
    rows = spark.read.parquet(out_path).count()
    new = [c for c in feats.columns if c in FEATURE_NAMES]
    return {"rows": rows, "total_features": len(feats.columns) - 1, "new_features": len(new),
            "columns": feats.columns}
