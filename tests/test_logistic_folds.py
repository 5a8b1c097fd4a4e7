"""The search of the baseline: one copy of the rows, shared curvatures, ranges of scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pdforge import session
from pdforge.operators import logistic_folds as LF
from pdforge.operators import models as MD


def _frame(spark, n=600, seed=4):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(40, 5, n), rng.normal(size=n).round(1)
    k = [str(v) if i != 7 else "once" for i, v in enumerate(rng.choice(["car", "home", "debt"], n))]  # a level that one fold does not train on
    y = ((a - 40) / 5 + b + rng.normal(size=n) > 0.2).astype(int)
    return spark.createDataFrame([(i, float(a[i]), float(b[i]), k[i], 2.5, int(y[i])) for i in range(n)], "loan_id long, a double, b double, k string, fixed double, label int")


SPEC = MD.ModelSpec(["a", "b", "fixed"], ["k"], [], 5)


def test_rows_are_written_once_and_scores_equal_single_fits(spark, monkeypatch):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pdforge.operators.splits import stratified_folds
    df, written, own = _frame(spark), [], session.materialize
    monkeypatch.setattr(session, "materialize", lambda f, name: written.append(f.count()) or own(f, name))
    got = [r.cv_auc for r in MD.tune_logistic_regression(df, SPEC, n_iter=3, folds=3)[1].collect()]
    assert written == [600]  # each fold's own copy made it five times as many
    data, total = MD.balanced_weights(df)
    data = stratified_folds(data, 3, label="label", seed=MD.K.RANDOM_SEED)
    auc = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction", numBins=0)
    want = []
    for d in MD.lr_param_draws(3):
        fits = [(MD.lr_pipeline(SPEC, d["C"], d["max_iter"], total * 2 / 3).fit(data.where(F.col("fold") != k)), data.where(F.col("fold") == k)) for k in range(3)]
        want.append(sum(auc.evaluate(m.transform(rows)) for m, rows in fits) / 3)
    assert got == pytest.approx(want, abs=1e-3)


def test_shared_curvatures_and_ranges_of_scores_change_nothing(spark, monkeypatch):
    df = _frame(spark).repartition(3, "loan_id")
    for spec in (SPEC, MD.ModelSpec(["a", "b"], [], [], 0)):
        with monkeypatch.context() as m:
            want = MD.tune_logistic_regression(df, spec, n_iter=6, folds=3)[1].collect()
            m.setattr(LF, "OWN_ROWS", 0)
            m.setattr(LF, "BUCKET", 30)
            m.setattr(LF, "SHOWN", 5)
            m.setattr(LF, "CHUNK", 64)
            got = MD.tune_logistic_regression(df, spec, n_iter=6, folds=3)[1].collect()
        assert [r.C for r in got] == [r.C for r in want] and [r.cv_auc for r in got] == pytest.approx([r.cv_auc for r in want], abs=1e-5)
