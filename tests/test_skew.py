"""Skew: one value / score / class holding a third of the rows, multi-bucket paths forced."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pdforge.operators import metrics as M
from pdforge.operators import splits as SP
from pdforge.operators.stats import exact_quantiles


def _skewed(n=6000, seed=5):
    rng = np.random.default_rng(seed)
    v = np.round(rng.normal(50, 15, n), 2)
    v[: n // 3] = 42.0  # one hot value: a third of all rows
    rng.shuffle(v)
    return v


def test_quantiles_with_hot_value(spark):
    v = _skewed()
    df = spark.createDataFrame([(float(x),) for x in v], "x double").repartition(8)
    for kw in ({}, {"finish_rows": 50, "grid": 8, "accuracy": 50}):
        q = {r.p: r.value for r in exact_quantiles(df, ["x"], [0.1, 0.5, 0.995], **kw).collect()}
        for p in (0.1, 0.5, 0.995):
            assert q[p] == pytest.approx(np.percentile(v, p * 100), abs=1e-9)


def test_curve_with_hot_score(spark):
    rng = np.random.default_rng(9)
    n = 6000
    s = np.round(rng.random(n), 3)
    s[: n // 3] = 0.5
    y = (rng.random(n) < s).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "score double, label int").repartition(8)
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    for kw in ({}, {"rows_per_bucket": 50}):
        m = M.curve_metrics(M.curve_table(df, **kw)).first()
        assert m["roc_auc"] == pytest.approx(want, abs=1e-12)


def test_stratified_sample_exact_size_and_mix(spark):
    rows = [(i, 1 if i % 10 == 0 else 0) for i in range(5000)]
    df = spark.createDataFrame(rows, "loan_id long, target int").repartition(8)
    s = SP.stratified_sample(df, 1000, finish_rows=20, grid=8, accuracy=50)
    counts = {r.target: r["count"] for r in s.groupBy("target").count().collect()}
    assert sum(counts.values()) == 1000 and counts[1] == 100


def test_samples_do_not_depend_on_partitioning(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(3000)], "loan_id long, target int")
    a = {r.loan_id for r in SP.deterministic_sample(df.repartition(1), 100).collect()}
    b = {r.loan_id for r in SP.deterministic_sample(df.repartition(8), 100).collect()}
    assert a == b and len(a) == 100
    fa = {(r.loan_id, r.fold) for r in SP.stratified_folds(df.repartition(1), 5).collect()}
    fb = {(r.loan_id, r.fold) for r in SP.stratified_folds(df.repartition(8), 5, finish_rows=20, grid=8, accuracy=50).collect()}
    assert fa == fb


def test_prefiltered_sample_equals_full_sort(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(20000)], "loan_id long, target int").repartition(8)
    got = {r.loan_id for r in SP.deterministic_sample(df, 300).collect()}
    u = df.withColumn("_u", SP.hash_order("loan_id"))
    want = {r.loan_id for r in u.orderBy("_u", "loan_id").limit(300).collect()}
    assert got == want and len(got) == 300
