"""Order statistics by sketched intervals, and class thresholds, against sorting on the driver."""

import numpy as np
from pyspark.sql import functions as F

from pdforge.operators import splits as SP
from pdforge.operators.cleaning import fit_statistics
from pdforge.operators.stats import quantile_values, sketch_columns, values_at_ranks

SMALL = {"finish_rows": 20, "grid": 6, "accuracy": 30}


def _frame(spark, n=3000):
    rng = np.random.default_rng(2)
    a = np.round(rng.lognormal(2, 1, n), 3)
    b = np.where(rng.random(n) < 1 / 3, 7.0, rng.integers(-5, 40, n)).astype(float)
    b_null = rng.random(n) < 0.4
    rows = [(float(x), None if z else int(y), None, int(g)) for x, y, z, g in zip(a, b, b_null, rng.integers(0, 2, n))]
    df = spark.createDataFrame(rows, "a double, b int, empty double, g int").repartition(5)
    return df, np.sort(a), np.sort(b[~b_null]), b, b_null


def test_every_rank_is_exact_in_one_and_in_many_rounds(spark):
    df, a, b, _, _ = _frame(spark)
    ranks = {"a": {0, 1, 1499, 1500, 2999}, "b": {0, len(b) // 2, len(b) - 1}, "empty": set()}
    for kw in ({}, SMALL):
        s = sketch_columns(df, ["a", "b", "empty"], **{k: v for k, v in kw.items() if k != "finish_rows"})
        assert (s["a"].n, s["b"].n, s["empty"].n) == (3000, len(b), 0)
        got = values_at_ranks(df, ranks, s, **kw)
        assert got == {**{("a", r): a[r] for r in ranks["a"]}, **{("b", r): b[r] for r in ranks["b"]}}


def test_a_wrong_sketch_costs_rounds_not_exactness(spark):
    df, a, _, _, _ = _frame(spark)
    s = sketch_columns(df, ["a"])
    s["a"].grid = [float(a[0])] * 401  # every proposed value lies far from the rank
    assert values_at_ranks(df, {"a": {1500}}, s, **SMALL) == {("a", 1500): a[1500]}


def test_caps_count_the_imputed_rows(spark):
    df, a, _, b, null = _frame(spark)
    for q in (0.2, 0.5, 0.6, 0.9, 0.995):
        got = fit_statistics(df, median_cols=["b", "empty"], cap_cols=["a", "b", "empty"], cap_q=q)
        median = float(np.median(b[~null]))
        assert got.medians == {"b": median, "empty": None} and got.caps["empty"] is None
        assert abs(got.caps["b"] - np.quantile(np.where(null, median, b), q)) < 1e-9
        assert abs(got.caps["a"] - np.quantile(a, q)) < 1e-9


def test_no_rows(spark):
    df = spark.createDataFrame([], "a double, loan_id long, target int")
    assert quantile_values(df, ["a"], [0.5]) == {("a", 0.5): None}
    assert SP.stratified_sample(df, 10).count() == 0 and SP.stratified_folds(df, 5).count() == 0


def test_sample_with_repeated_and_null_keys_has_its_size(spark):
    df = spark.range(900).select(F.when(F.col("id") % 3 > 0, F.lit(5)).alias("loan_id"), F.col("id").alias("x"),
                                 (F.col("id") % 2).cast("int").alias("target"))
    got = [sorted(r.x for r in SP.stratified_sample(df.repartition(p), 100).collect()) for p in (1, 6)]
    assert got[0] == got[1] and len(set(got[0])) == 100


def test_folds_are_equal_and_take_no_shuffle(spark):
    df = spark.range(1003).select(F.col("id").alias("loan_id"), F.when(F.col("id") % 7 > 0, F.col("id") % 2).alias("target"))
    folds = SP.stratified_folds(df, 5)
    sizes = folds.groupBy("target", "fold").count().groupBy("target").agg(
        F.count("fold").alias("k"), (F.max("count") - F.min("count")).alias("spread")).collect()
    assert all(r.k == 5 and r.spread <= 1 for r in sizes) and len(sizes) == 3
    assert "Exchange" not in folds._jdf.queryExecution().executedPlan().toString()
