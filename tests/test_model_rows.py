"""Model queries clean the loans once; means of levels are counts."""

from pyspark.sql import functions as F

from paths import SF001
from pdforge.operators import compiled as CM
from pdforge.operators import explain as EX


def test_scoring_templates_and_attribution_read_the_written_rows(spark, monkeypatch):
    from pdforge.plans import catalog_models as CMo
    from pdforge.plans import catalog_scoring as CS
    own_template = CS.template(spark, SF001)
    calls, own = [], CMo.features
    monkeypatch.setattr(CMo, "_SAVED", {})
    for module in (CMo, CS):
        monkeypatch.setattr(module, "features", lambda s, d, *a: calls.append(d) or own(s, d, *a))
    path = CMo.saved_model(spark, SF001, "lr")
    CMo._SAVED[(spark.sparkContext.applicationId, SF001, "champion")] = path
    scenarios, batch = CMo.b5_scenarios_model(spark, SF001).collect(), CMo.b2_score_batch_model(spark, SF001)
    apps, sums = CMo.b4_application_scoring_model(spark, SF001).count(), CMo.t12_baseline_attribution(spark, SF001)
    template = CMo._template(spark, SF001)
    assert len(calls) == 1 and len(scenarios) == 4 and apps > 0
    assert sums.where("not adds_up").count() == 0 < sums.count()
    assert template.schema == own_template.schema and template.collect() == own_template.collect()
    fresh = CMo.SC.score_batch(CM.load_compiled(path).score(CMo.SP.with_split(own(spark, SF001), **CMo.K.FIXTURE_SPLIT)))
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, fresh.select(*batch.columns).collect()))


def test_means_of_flags_are_counts(spark):
    df = spark.createDataFrame([("a", 1.5), ("b", -2.25), (None, 0.125), ("a", None)], "k string, x double")
    flag = F.col("k").eqNullSafe("a")
    columns, coefs = {"k=a": flag.cast("double"), "x": F.col("x")}, {"k=a": 2.0, "x": 1.0}
    plain, counted = EX.LinearAttribution.fit(df, coefs, columns=columns), EX.LinearAttribution.fit(df, coefs, columns=columns, flags={"k=a": flag})
    assert plain.means == counted.means == {"k=a": 0.5, "x": -0.625 / 3}
    empty = EX.LinearAttribution.fit(df.limit(0), coefs, columns=columns, flags={"k=a": flag})
    assert empty.means == {"k=a": 0.0, "x": 0.0}


def test_the_search_of_the_baseline_reads_every_row(spark, monkeypatch):
    from pdforge.plans import catalog_models as CMo
    seen = []
    monkeypatch.setattr(CMo.K, "CV_MAX_ROWS", 100, raising=False)  # the cap it once had
    monkeypatch.setattr(CMo.MD, "tune_logistic_regression", lambda rows, spec: (None, seen.append(rows.count()) or rows))
    CMo.t8_lr_random_search(spark, SF001)
    f = CMo.model_data(spark, SF001)[0]
    assert seen == [f.where(F.col("split").isin("train", "val")).count()] and seen[0] > 100
