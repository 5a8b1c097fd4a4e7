"""Curve metrics against the hand example, numpy, and partition independence."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pdforge.operators import metrics as M
from pdforge.operators.stats import exact_quantiles, prefix_sums

HAND = [(0.9, 0), (0.8, 1), (0.7, 1), (0.6, 0), (0.5, 1), (0.4, 0)]


def test_hand_example(spark):
    df = spark.createDataFrame(HAND, "score double, label int")
    m = M.curve_metrics(M.curve_table(df)).first()
    assert m["roc_auc"] == pytest.approx(0.555556, abs=1e-6)
    assert m["pr_auc"] == pytest.approx(0.461111, abs=1e-6)
    assert m["ks_stat_pct"] == pytest.approx(33.3333, abs=1e-4)
    assert m["youden_threshold"] == 0.7
    assert m["gini"] == pytest.approx(2 * 0.555556 - 1, abs=1e-5)


def test_single_class(spark):
    df = spark.createDataFrame([(0.3, 1), (0.2, 1)], "score double, label int")
    m = M.curve_metrics(M.curve_table(df)).first()
    assert m["roc_auc"] is None and m["ks_stat_pct"] == 0.0 and m["youden_threshold"] == float("inf")



def _auc_numpy(scores, labels):
    s, y = np.asarray(scores), np.asarray(labels)
    pos, neg = s[y == 1], s[y == 0]
    gt = (pos[:, None] > neg[None, :]).sum()
    eq = (pos[:, None] == neg[None, :]).sum()
    return (gt + 0.5 * eq) / (len(pos) * len(neg))


def test_auc_ties_and_buckets(spark):
    rng = np.random.default_rng(7)
    scores = np.round(rng.random(3000), 2)  # many ties
    labels = (rng.random(3000) < scores).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(scores, labels)], "score double, label int")
    want = _auc_numpy(scores, labels)
    for kw in ({}, {"rows_per_bucket": 7}):  # one bucket, and the multi-bucket path
        m = M.curve_metrics(M.curve_table(df, **kw)).first()
        assert m["roc_auc"] == pytest.approx(want, abs=1e-12)


def test_partition_independence(spark):
    rng = np.random.default_rng(3)
    rows = [(float(a), int(b)) for a, b in zip(np.round(rng.random(2000), 3), rng.integers(0, 2, 2000))]
    df = spark.createDataFrame(rows, "score double, label int")
    a = M.curve_metrics(M.curve_table(df.repartition(1))).first().asDict()
    b = M.curve_metrics(M.curve_table(df.repartition(8))).first().asDict()
    assert a == b


def test_prefix_sums_bucketed_equals_single(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), float(v), int(c)) for g, v, c in zip(rng.integers(0, 3, 500), rng.random(500), rng.integers(1, 5, 500))]
    df = spark.createDataFrame(rows, "g int, v double, c int").dropDuplicates(["g", "v"])
    one = {(r.g, r.v): r.c_before for r in prefix_sums(df, ["g"], "v", ["c"]).collect()}
    many = {(r.g, r.v): r.c_before for r in prefix_sums(df, ["g"], "v", ["c"], rows_per_bucket=10).collect()}
    assert one == many
    # brute force
    pdf = df.toPandas().sort_values(["g", "v"])
    pdf["want"] = pdf.groupby("g")["c"].cumsum() - pdf["c"]
    assert all(one[(r.g, r.v)] == r.want for r in pdf.itertuples())


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(11)
    a = np.round(rng.lognormal(3, 1, 1001), 1)
    b = np.where(rng.random(1001) < 0.2, np.nan, rng.integers(0, 5, 1001).astype(float))
    rows = [(float(x), None if np.isnan(y) else float(y)) for x, y in zip(a, b)]
    df = spark.createDataFrame(rows, "a double, b double")
    for kw in ({}, {"finish_rows": 20, "grid": 8, "accuracy": 50}):
        q = {(r.column, r.p): r.value for r in exact_quantiles(df, ["a", "b"], [0.5, 0.995], **kw).collect()}
        assert q[("a", 0.5)] == pytest.approx(np.percentile(a, 50), abs=1e-9)
        assert q[("a", 0.995)] == pytest.approx(np.percentile(a, 99.5), abs=1e-9)
        assert q[("b", 0.5)] == pytest.approx(np.nanpercentile(b, 50), abs=1e-9)


def test_confusion_zero_division(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 0)], "score double, label int")
    r = M.confusion(df, 0.5).first()
    assert (r["precision"], r["recall"], r["f1"], r["accuracy"]) == (0.0, 0.0, 0.0, 1.0)


def _brute_bundle(rows, t):
    s, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    pred = s >= t
    tp, fp = int((pred & (y == 1)).sum()), int((pred & (y == 0)).sum())
    return round(_auc_numpy(s, y), 4), round(tp / (tp + fp), 4) if tp + fp else 0.0, round(tp / (y == 1).sum(), 4)


def _model_rows(seed=5):
    rng = np.random.default_rng(seed)
    out = []
    for model, noise in (("a", 0.2), ("b", 2.0)):
        for split, n in (("val", 400), ("test", 700)):
            y = rng.integers(0, 2, n)
            s = np.round(1 / (1 + np.exp(-(y + noise * rng.normal(size=n)))), 3 if model == "a" else 12)
            out += [(model, split, int(b), float(a)) for a, b in zip(s, y)]
    return out


def test_models_evaluated_together_equal_each_alone(spark):
    rows = _model_rows()
    df = spark.createDataFrame(rows, "model string, split string, label int, score double")
    got = {(r["model"], r["split"]): r.asDict() for r in M.evaluate_models(df, report=("val", "test")).collect()}
    assert set(got) == {(m, s) for m in "ab" for s in ("val", "test")}
    for model in "ab":
        one = lambda s: df.where((F.col("model") == model) & (F.col("split") == s)).select("label", "score")
        t = M.youden_threshold(one("val"))
        for split in ("val", "test"):
            want = M.metric_bundle(one(split), t).first().asDict()
            assert {c: got[model, split][c] for c in M.BUNDLE} == want
            auc, precision, recall = _brute_bundle([(s, y) for m, sp, y, s in rows if (m, sp) == (model, split)], t)
            assert (want["roc_auc"], want["default_precision"], want["default_recall"]) == pytest.approx((auc, precision, recall), abs=1e-4)


def test_confusion_of_groups_equals_confusion_of_rows(spark):
    df = spark.createDataFrame([(0.2, 0), (0.2, 1), (0.7, 1), (None, 1), (0.9, None), (0.5, 0)], "score double, label int")
    a = M.confusion(df, 0.5).first()
    b = M.confusion_of_groups(M.score_groups(df), F.lit(0.5)).first()
    assert a == b


def test_close_scores_are_not_merged(spark):
    """Two thresholds below the fourth place stay apart: rounding them would lose the whole ranking."""
    df = spark.createDataFrame([(0.30001, 1), (0.30002, 1), (0.29999, 0), (0.29998, 0)], "score double, label int")
    m = M.curve_metrics(M.curve_table(df)).first()
    assert m["roc_auc"] == 1.0 and m["youden_threshold"] == 0.30001


def test_groups_with_nulls_single_classes_and_no_rows(spark):
    schema = "model string, split string, label int, score double"
    rows = [(None, "val", 1, 0.9), (None, "val", 0, 0.1), (None, "test", 1, 0.8), (None, "test", 0, 0.2),
            ("one", "val", 1, 0.4), ("one", "test", 1, 0.6), ("uncut", "test", 1, 0.6), ("uncut", "test", 0, 0.5)]
    got = {r["model"]: r for r in M.evaluate_models(spark.createDataFrame(rows, schema)).collect()}
    assert got[None]["roc_auc"] == 1.0 and got[None]["threshold"] == 0.9 and got[None]["default_recall"] == 0.0
    assert got["one"]["roc_auc"] is None and got["one"]["threshold"] == float("inf")
    assert got["uncut"]["roc_auc"] == 1.0 and got["uncut"]["threshold"] is None and got["uncut"]["accuracy"] is None
    assert M.evaluate_models(spark.createDataFrame([], schema)).collect() == []
    assert M.curve_metrics(M.curve_table(spark.createDataFrame([], "label int, score double"))).first()["roc_auc"] is None


def test_compare_models(spark):
    names = {"a": "baseline", "b": "challenger"}
    df = spark.createDataFrame([(names[m], *rest) for m, *rest in _model_rows()], "model string, split string, label int, score double")
    bundles = M.evaluate_models(df)
    by = {r["model"]: r for r in bundles.collect()}
    rows = {r["metric"]: r for r in M.compare_models(bundles).collect()}
    assert set(rows) == set(M.BUNDLE)
    for c in M.BUNDLE:
        assert rows[c]["delta"] == pytest.approx(by["challenger"][c] - by["baseline"][c], abs=1e-9)
