"""Counts beyond 64-bit products, null groups, integer columns with fractional statistics."""

from pyspark.sql import functions as F


def test_curve_metrics_beyond_64_bit_products(spark):
    from pdforge.operators.metrics import curve_metrics

    big = 10 ** 10
    curve = spark.createDataFrame(
        [(0.9, big // 2, big // 4, 0, 0, big // 2, big // 4, big, big),
         (0.1, big // 2, 3 * big // 4, big // 2, big // 4, big, big, big, big)],
        "score double, pos long, neg long, tp_before long, fp_before long, tp long, fp long, P long, N long")
    m = curve_metrics(curve).first()
    # pairs won: 1/2 * 3/4, tied: 1/2 * 1/4 + 1/2 * 3/4
    assert abs(m["roc_auc"] - (0.375 + 0.25)) < 1e-12
    assert abs(m["ks_stat_pct"] - 25.0) < 1e-9 and m["youden_threshold"] == 0.9


def test_null_class_stays_in_bucketed_ranks(spark):
    from pdforge.operators.splits import stratified_folds, stratified_sample

    df = spark.range(1000).select(F.col("id").alias("loan_id"), F.when(F.col("id") >= 100, F.col("id") % 2).alias("target"))
    assert stratified_folds(df, finish_rows=20, grid=8, accuracy=50).count() == 1000
    got = {r["target"]: r["count"] for r in stratified_sample(df, 100, finish_rows=20, grid=8, accuracy=50).groupBy("target").count().collect()}
    assert got == {None: 10, 0: 45, 1: 45}


def test_integer_columns_take_fractional_statistics(spark):
    from pdforge.operators.cleaning import CleaningStats, cap_outliers, impute_medians

    df = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "a int")
    stats = CleaningStats(medians={"a": 2.5}, caps={"a": 3.5})
    assert sorted(r.a for r in impute_medians(df, stats).collect()) == [1.0, 2.0, 2.5, 3.0, 4.0]
    assert sorted(r.a for r in cap_outliers(df.dropna(), stats).collect()) == [1.0, 2.0, 3.0, 3.5]
