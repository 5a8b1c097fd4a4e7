"""Model queries, samples, sinks and loaders: training, tuning, attribution of
trees. ``oracle_models`` holds the SQL of what SQL can say about them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pdforge import constants as K
from pdforge.operators import columns as C
from pdforge.operators import compiled as CM
from pdforge.operators import explain as EX
from pdforge.operators import models as MD
from pdforge.operators import scoring as SC
from pdforge.operators import splits as SP
from pdforge.plans import oracle_models as OM
from pdforge.plans.catalog import A8_SQL, features, raw, register, scored, scored_split
from pdforge.session import scratch_path
from pdforge.sources import io

#: Paths of the models trained and rows written in this session, by application, input folder and kind.
_SAVED: dict = {}


def model_data(spark, d):
    """The model frame and its specification. The rows are written once a session and folder, as the models are: fits,
    thresholds, comparisons, scoring, templates and attribution read the written columns instead of cleaning the loans
    again."""
    key = (spark.sparkContext.applicationId, d, "rows")
    if key not in _SAVED:
        path = scratch_path(spark, "model_rows")
        MD.spread(SP.with_split(MD.model_frame(features(spark, d)), **K.FIXTURE_SPLIT)).write.parquet(path)
        _SAVED[key] = (path, MD.infer_spec(spark.read.parquet(path)))
    path, spec = _SAVED[key]
    return spark.read.parquet(path), spec


def _split(f, name):
    return f.where(SP.split_predicate(name, **K.FIXTURE_SPLIT))


def _lr(spark, d):
    f, spec = model_data(spark, d)
    m = MD.train_logistic_regression(_split(f, "train"), _split(f, "val"), spec)
    return m, f, spec


def _gbt(spark, d, params=None):
    f, spec = model_data(spark, d)
    m = MD.train_gbt(_split(f, "train"), _split(f, "val"), spec, params)
    return m, f, spec


def saved_model(spark, d, kind: str) -> str:
    """Folder of the trained baseline ("lr"), challenger ("gbt", library defaults) or the better of both ("champion").

    A model is trained once a session and saved with its metadata (S12); scoring, attribution and comparison read it
    back (S13), as later jobs would.
    """
    key = (spark.sparkContext.applicationId, d, kind)
    if key not in _SAVED:
        if kind == "champion":
            both = {k: MD.load_model(saved_model(spark, d, k)) for k in ("gbt", "lr")}
            f = _split(model_data(spark, d)[0], "test")
            MD.evaluate_together(list(both.values()), f)
            best = MD.champion(list(both.values()))
            path = scratch_path(spark, "model_champion")
            MD.save_model(best, path)
        else:
            m, _, _ = (_lr if kind == "lr" else _gbt)(spark, d)
            path = scratch_path(spark, f"model_{kind}")
            MD.save_model(m, path)
        _SAVED[key] = path
    return _SAVED[key]


def _test_predictions(m, f, spec):
    return MD.predict_pd(m.model, MD.fill_missing(_split(f, "test"), spec)).select("loan_id", MD.LABEL, "pd")


def _probabilities(pred: DataFrame) -> DataFrame:
    """The scored rows, each with whether its PD is a probability."""
    return pred.select("loan_id", MD.LABEL, F.col("pd").between(0.0, 1.0).alias("is_probability"))


@register("t1_standardize", OM.standardized())
def t1_standardize(spark, d):
    from pyspark.ml.functions import vector_to_array
    m, f, spec = _lr(spark, d)
    out = m.model.transform(MD.fill_missing(_split(f, "test"), spec))
    scaled = vector_to_array("_num_std")
    return out.select("loan_id", F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.round(scaled[i], 6).alias("scaled")) for i, c in enumerate(spec.numeric)])))


@register("t2_one_hot", OM.one_hot())
def t2_one_hot(spark, d):
    """The hot position of each categorical column; -1 where the level is unseen or null (all zeros)."""
    from pyspark.ml.functions import vector_to_array
    m, f, spec = _lr(spark, d)
    out = m.model.transform(MD.fill_missing(_split(f, "test"), spec))
    return out.select("loan_id", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"),
                 (F.array_position(vector_to_array(f"{c}_ohe"), 1.0) - 1).cast("int").alias("position"))
        for c in spec.categorical])))


@register("t3_logistic_regression", OM.TEST_ROWS)
def t3_logistic_regression(spark, d):
    m, f, spec = _lr(spark, d)
    return _probabilities(_test_predictions(m, f, spec))


@register("t4_gradient_boosted_trees", OM.TEST_ROWS)
def t4_gradient_boosted_trees(spark, d):
    f, _ = model_data(spark, d)
    m = MD.load_model(saved_model(spark, d, "gbt"))
    return _probabilities(_test_predictions(m, f, m.spec))


@register("t5_predict_pd")
def t5_predict_pd(spark, d):
    m, f, spec = _lr(spark, d)
    return SC.score_batch(MD.predict_pd(m.model, MD.fill_missing(_split(f, "test"), spec))) \
        .select("loan_id", "probability_of_default", "risk_tier", "policy_decision")


@register("t6_validation_indicator", OM.TEST_ROWS)
def t6_validation_indicator(spark, d):
    f, spec = model_data(spark, d)
    tv = MD.fill_missing(f.where(F.col("split").isin("train", "val")), spec) \
        .withColumn("is_val", F.col("split") == "val")
    _, ratio = MD.positive_weight(_split(f, "train"))  # class ratio of the training years alone
    tv = tv.withColumn(MD.WEIGHT, F.when(F.col(MD.LABEL) == 1, ratio).otherwise(1.0))
    model = MD.gbt_pipeline(spec, validation_col="is_val").fit(tv)
    return _probabilities(MD.predict_pd(model, MD.fill_missing(_split(f, "test"), spec)))


@register("t7_champion")
def t7_champion(spark, d):
    """Both models on the test year, and which of them the saved champion is."""
    best = MD.load_model(saved_model(spark, d, "champion"))
    f = _split(model_data(spark, d)[0], "test")
    rows = []
    for k in ("gbt", "lr"):
        m = MD.load_model(saved_model(spark, d, k))
        t = MD.evaluate(m.model, MD.fill_missing(f, m.spec), m.threshold)
        rows.append((m.name, m.threshold, t["roc_auc"], t["pr_auc"], t["ks_stat_pct"], m.name == best.name))
    return spark.createDataFrame(rows, "model string, threshold double, roc_auc double, pr_auc double, "
                                       "ks_stat_pct double, is_champion boolean")


@register("t8_lr_random_search")
def t8_lr_random_search(spark, d):
    """Every train and validation row takes part in the search."""
    f, spec = model_data(spark, d)
    return MD.tune_logistic_regression(f.where(F.col("split").isin("train", "val")), spec)[1]


#: Trials and space of the registered searches of trees; ``MD.GBT_SPACE`` and 50 trials are the library's own.
SHORT_TRIALS, SHORT_SPACE = 2, {**MD.GBT_SPACE, "n_estimators": ("int", 20, 100), "max_depth": ("int", 3, 8)}


def tuned_store(spark, d) -> str:
    """The parameter table of this session and folder, with the winner of the search of trees."""
    key = (spark.sparkContext.applicationId, d, "params")
    if key not in _SAVED:
        f, spec = model_data(spark, d)
        best, res = MD.tune_gbt(_split(f, "train"), _split(f, "val"), spec, SHORT_TRIALS, space=SHORT_SPACE)
        path = scratch_path(spark, "tuned_params")
        MD.save_params(spark, path, "Gradient-Boosted Trees", best, res.agg(F.max("val_auc")).first()[0])
        res.write.parquet(f"{path}-trials")
        _SAVED[key] = path
    return _SAVED[key]


@register("t9_gbt_random_search")
def t9_gbt_random_search(spark, d):
    return spark.read.parquet(tuned_store(spark, d) + "-trials")


@register("t10_tuned_params")
def t10_tuned_params(spark, d):
    """The challenger trained with the newest parameters of the parameter table."""
    f, spec = model_data(spark, d)
    best = MD.latest_params(spark, tuned_store(spark, d), "Gradient-Boosted Trees")
    m = MD.train_gbt(_split(f, "train"), _split(f, "val"), spec, best["params"])
    used = m.model.stages[-1]
    return spark.createDataFrame([(json.dumps(best["params"]), best["version"], used.getMaxIter(), used.getStepSize(), used.getMaxDepth(),
                                   m.threshold)],
                                 "requested string, version int, max_iter int, step_size double, max_depth int, threshold double")


def _tree_attribution(spark, d, split: str | None = "test"):
    """Rows of one split, or of all years, with the PD and the long attribution of the saved challenger."""
    f, _ = model_data(spark, d)
    m = MD.load_model(saved_model(spark, d, "gbt"))
    rows = MD.fill_missing(f if split is None else _split(f, split), m.spec)
    prepared = MD.predict_pd(m.model, rows, keep=("features",))
    names = MD.numeric_inputs(m.spec) + [f"{c}_idx" for c in m.spec.categorical]
    return prepared, EX.tree_shap_frame(prepared, m.model.stages[-1], names)


@register("t11_global_attribution")
def t11_global_attribution(spark, d):
    """Mean absolute attribution of every model input, over the rows of all years."""
    attr = _tree_attribution(spark, d, None)[1].where(F.col("feature") != "__base__")
    return EX.importance_ranking(EX.mean_abs_attribution(attr))


@register("t13_tree_attribution", OM.ADDITIVE)
def t13_tree_attribution(spark, d):
    """Whether base value and attributions of each test row add up to the log-odds of its PD."""
    prepared, attr = _tree_attribution(spark, d)
    total = attr.groupBy("loan_id").agg(F.sum("phi").alias("total"))
    log_odds = F.log(F.col("pd") / (1 - F.col("pd")))
    return prepared.join(total, "loan_id", "left").select(
        "loan_id", F.coalesce(F.abs(F.col("total") - log_odds) < 1e-6, F.lit(False)).alias("adds_up"))


def champion_scored(spark, d, split: str | None = None) -> DataFrame:
    """Feature rows with the compiled champion's PD: projections without a Python worker."""
    m = CM.load_compiled(saved_model(spark, d, "champion"))
    f, _ = model_data(spark, d)
    return m.score(f if split is None else _split(f, split))


@register("s13_compiled_scores", OM.ROUND_TRIP)
def s13_compiled_scores(spark, d):
    """Whether each saved model, compiled to columns, gives each test row the PD of MLlib's own transform."""
    f = _split(model_data(spark, d)[0], "test")
    out = f.select("loan_id", F.lit(True).alias("same_pd"))
    for k in ("lr", "gbt"):
        path = saved_model(spark, d, k)
        m = MD.load_model(path)
        own = MD.predict_pd(m.model, MD.fill_missing(f, m.spec), "own").select("loan_id", F.col("own"))
        got = f.select("loan_id", CM.load_compiled(path).pd().alias("pd"))
        near = own.join(got, "loan_id").select("loan_id", (F.abs(F.col("own") - F.col("pd")) < 1e-9).alias("near"))
        out = out.join(near, "loan_id", "left").select("loan_id", (F.col("same_pd") & F.coalesce("near", F.lit(False))).alias("same_pd"))
    return out


@register("b1_decision_records_model")
def b1_decision_records_model(spark, d):
    """Decision records of the test year with the champion's name and threshold."""
    m = CM.load_compiled(saved_model(spark, d, "champion"))
    r = SC.decision_records(champion_scored(spark, d, "test"), "pd", m.threshold, m.name)
    return r.select("loan_id", "model", "threshold", "probability_of_default", "predicted_default",
                    "risk_bucket.risk_tier", "policy_decision.decision")


@register("b2_score_batch_model")
def b2_score_batch_model(spark, d):
    return SC.score_batch(champion_scored(spark, d)).select("loan_id", "probability_of_default", "risk_tier", "credit_grade",
                                                            "recommended_action", "policy_decision")


def _template(spark, d):
    from pdforge.plans.catalog_scoring import template
    return template(spark, d, model_data(spark, d)[0].drop(MD.LABEL))


def _application_inputs(spark, d):
    from pdforge.plans.catalog_scoring import applications
    m = CM.load_compiled(saved_model(spark, d, "champion"))
    return applications(spark, d), _template(spark, d), m.score


@register("b4_application_scoring_model")
def b4_application_scoring_model(spark, d):
    from pdforge.plans.catalog_scoring import APP_OUT_COLS
    apps, template, pd_of = _application_inputs(spark, d)
    return SC.score_applications(apps, template, pd_of).select(*APP_OUT_COLS)


@register("b5_scenarios_model")
def b5_scenarios_model(spark, d):
    m = CM.load_compiled(saved_model(spark, d, "champion"))
    out = SC.score_applications(SC.scenario_frame(spark), _template(spark, d), m.score)
    return out.select("application_id", "scenario", "probability_of_default", "risk_tier", "policy_decision")


@register("b6_portfolio_analysis_model")
def b6_portfolio_analysis_model(spark, d):
    from pdforge.operators.portfolio import portfolio_summary
    return portfolio_summary(SC.score_batch(champion_scored(spark, d, "test")))


@register("st1_stream_scoring_model")
def st1_stream_scoring_model(spark, d):
    """The stream scores arriving applications with the same compiled champion as the batch job."""
    from pdforge.plans.catalog_scoring import APP_OUT_COLS
    from pdforge.streaming.scoring_stream import score_application_files
    apps, template, pd_of = _application_inputs(spark, d)
    return score_application_files(spark, apps, template, pd_fn=pd_of).select(*APP_OUT_COLS)


def _baseline_attribution(spark, d):
    """(attribution of the fitted baseline, training rows as background; rows of the test year)."""
    m = CM.load_compiled(saved_model(spark, d, "lr"))
    f, _ = model_data(spark, d)
    return m, CM.linear_attribution(m, _split(f, "train")), _split(f, "test")


@register("t12_baseline_attribution", OM.ADDITIVE)
def t12_baseline_attribution(spark, d):
    """Whether base value and all terms of the fitted baseline (inputs and levels) add up to each row's log-odds."""
    m, a, test = _baseline_attribution(spark, d)
    total = F.aggregate(F.transform(a.contributions(), lambda s: s["phi"]), F.lit(a.base_value()), lambda x, y: x + y)
    return test.select("loan_id", F.coalesce(F.abs(total - m.log_odds) < 1e-6, F.lit(False)).alias("adds_up"))


@register("w5_top_features_model")
def w5_top_features_model(spark, d):
    """The 15 terms of the fitted baseline with the largest mean absolute attribution."""
    _, a, test = _baseline_attribution(spark, d)
    return EX.importance_ranking(EX.mean_abs_attribution(a.explain(test))).limit(15).select("feature", "mean_abs_phi", "importance_rank")


@register("w6_top_factors_per_loan_model")
def w6_top_factors_per_loan_model(spark, d):
    """Five of all terms of the fitted baseline for each loan, by an in-row sort."""
    _, a, test = _baseline_attribution(spark, d)
    return a.top_factors(test, 5)


@register("b1_decision_records", OM.DECISIONS)
def b1_decision_records(spark, d):
    """The decision records, their nested parts as columns."""
    r = SC.decision_records(scored(spark, d), "pd", threshold=0.22)
    return r.select("loan_id", "model", "threshold", "probability_of_default", "predicted_default",
                    *[f"risk_bucket.{c}" for c in ("risk_tier", "credit_grade", "recommended_interest_rate",
                                                   "risk_description", "recommended_action")],
                    "policy_decision.decision", "policy_decision.comments",
                    F.size("policy_decision.adverse_action_reasons").alias("n_adverse"))


@register("b3_held_out_sample")
def b3_held_out_sample(spark, d):
    return SC.held_out_sample(features(spark, d), n=1000, year=K.FIXTURE_TEST_YEAR)


@register("p8_feature_types", OM.FEATURE_KINDS)
def p8_feature_types(spark, d):
    num, cat = C.split_feature_types(C.drop_non_features(features(spark, d)), exclude=("loan_id",))
    return spark.createDataFrame([(c, "numeric") for c in num] + [(c, "categorical") for c in cat],
                                 "column string, kind string")


@register("p9_align_features", OM.ALIGNED)
def p9_align_features(spark, d):
    f = features(spark, d)
    num, cat = C.split_feature_types(C.drop_non_features(f), exclude=("loan_id",))
    return C.align_features(f, num + cat)


@register("w8_seeded_sample")
def w8_seeded_sample(spark, d):
    return SP.deterministic_sample(features(spark, d), 1000)


@register("w9_stratified_sample")
def w9_stratified_sample(spark, d):
    f = SP.with_split(features(spark, d), **K.FIXTURE_SPLIT).where(F.col("split").isin("train", "val"))
    n = f.count() // 2
    return SP.stratified_sample(f, n)


@register("w10_stratified_folds", OM.FOLDS)
def w10_stratified_folds(spark, d):
    f = SP.with_split(features(spark, d), **K.FIXTURE_SPLIT).where(F.col("split").isin("train", "val"))
    return SP.stratified_folds(f, 5).groupBy("fold", "target").count()


@register("s3_parquet_sink", OM.RAW_ROWS)
def s3_parquet_sink(spark, d):
    path = scratch_path(spark, "raw_parquet")
    raw(spark, d).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@register("s4_export_verify", OM.EXPORT)
def s4_export_verify(spark, d):
    csv = io.write_scratch(raw(spark, d), "csv", "raw_csv")
    stats = io.csv_to_parquet(spark, csv, scratch_path(spark, "raw_from_csv"))
    return spark.createDataFrame([(stats["rows"], stats["columns"], stats["bytes"] > 0)],
                                 "rows long, columns int, has_bytes boolean")


@register("s5_parquet_schema", OM.SCHEMA)
def s5_parquet_schema(spark, d):
    path = io.write_scratch(raw(spark, d), "parquet", "raw_schema")
    schema = io.scan_schema(spark, path)
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in schema.fields],
                                 "column string, type string")


@register("s7_partitioned_write", OM.TEST_YEAR_FEATURES)
def s7_partitioned_write(spark, d):
    path = io.write_table(features(spark, d), scratch_path(spark, "features_by_year"))
    back = spark.read.parquet(path).where(F.col("issue_year") == K.FIXTURE_TEST_YEAR)
    return back.withColumn("issue_year", F.col("issue_year").cast("smallint"))  # a folder name reads as int


@register("s8_small_csv_write", A8_SQL)
def s8_small_csv_write(spark, d):
    """Tier validation written as one CSV file, read back with its schema (values survive exactly)."""
    from pdforge.operators.portfolio import tier_validation
    t = tier_validation(scored_split(spark, d, "test"))
    path = io.write_small_csv(t, scratch_path(spark, "tiers_csv"))
    return io.read_small_csv(spark, path, t.schema)


@register("s10_json_write", OM.METRICS_WITH_BUCKETS)
def s10_json_write(spark, d):
    """Metric bundle plus nested bucket summary written as JSON; read back, one row a bucket."""
    from pdforge.operators import metrics as M
    from pdforge.operators.portfolio import tier_validation
    test = scored_split(spark, d, "test")
    bundle = M.metric_bundle(test.select(F.col("target").cast("int").alias("label"),
                                         F.col("pd").alias("score")), 0.22)
    buckets = tier_validation(test).agg(F.collect_list(F.struct("risk_tier", "count", "avg_pd",
                                                                "actual_default_rate")).alias("bucket_summary"))
    row = bundle.first().asDict()  # one row of metrics
    doc = buckets.select(*[F.lit(v).alias(k) for k, v in row.items()], "bucket_summary")
    path = io.write_json(doc, scratch_path(spark, "comparison"))
    return io.read_json(spark, path, doc.schema).select(*row, F.inline("bucket_summary"))


@register("s12_model_save", OM.SAVED_MODEL)
def s12_model_save(spark, d):
    """Save the baseline model and its metadata; the feature lists that the metadata file holds."""
    m, f, spec = _lr(spark, d)
    path = scratch_path(spark, "model_save")
    MD.save_model(m, path)
    kept = F.from_json("metadata", "name string, numerical_features array<string>, categorical_features array<string>")
    lists = spark.read.json(f"{path}/metadata").select(kept.alias("m")).select("m.*")
    kinds = [lists.select("name", F.explode(f"{k}_features").alias("column"), F.lit(kind).alias("kind"))
             for k, kind in (("numerical", "numeric"), ("categorical", "categorical"))]
    return kinds[0].unionByName(kinds[1])


@register("s9_small_csv_roundtrip", A8_SQL)
def s9_small_csv_roundtrip(spark, d):
    from pdforge.operators.portfolio import tier_validation
    t = tier_validation(scored_split(spark, d, "test"))
    path = io.write_small_csv(t, scratch_path(spark, "tiers_csv"))
    return io.read_small_csv(spark, path, t.schema)


@register("s11_json_roundtrip", OM.BUCKETS)
def s11_json_roundtrip(spark, d):
    from pdforge.operators.portfolio import tier_validation
    t = tier_validation(scored_split(spark, d, "test"))
    nested = t.agg(F.collect_list(F.struct("risk_tier", "count", "avg_pd", "actual_default_rate"))
                   .alias("bucket_summary"))  # five tier rows
    path = io.write_json(nested, scratch_path(spark, "comparison_json"))
    return io.read_json(spark, path).select(F.inline("bucket_summary"))


@register("s13_model_roundtrip", OM.ROUND_TRIP)
def s13_model_roundtrip(spark, d):
    """Whether the model read back gives each test row the PD of the model that was saved."""
    m, f, spec = _lr(spark, d)
    path = scratch_path(spark, "model")
    MD.save_model(m, path)
    back = MD.load_model(path)
    saved = MD.predict_pd(m.model, MD.fill_missing(_split(f, "test"), spec))
    both = MD.predict_pd(back.model, saved.withColumnRenamed("pd", "saved_pd"))
    return both.select("loan_id", (F.col("pd") == F.col("saved_pd")).alias("same_pd"))


@register("s14_write_if_absent", OM.RAW_ROWS)
def s14_write_if_absent(spark, d):
    path = scratch_path(spark, "once")
    io.write_table(raw(spark, d), path, partition_by=None, mode="ignore")
    io.write_table(raw(spark, d).limit(0), path, partition_by=None, mode="ignore")  # second write is skipped
    return spark.read.parquet(path)


@register("b7_cleaning_job_sink", OM.JOB_SINK)
def b7_cleaning_job_sink(spark, d):
    """B7 end to end with its sink and statistics; returns the statistics as one row."""
    from pdforge.plans.cleaning_job import write_cleaning_job
    out = scratch_path(spark, "loans_cleaned")
    st = write_cleaning_job(raw(spark, d), out, stats_path=scratch_path(spark, "cleaning_stats"))
    keys = ["raw_rows", "raw_columns", "cleaned_rows", "cleaned_columns", "rows_removed", "rows_removed_pct",
            "default_count", "non_default_count", "default_rate_pct"]
    return spark.createDataFrame([tuple(st[k] for k in keys)],
                                 "raw_rows long, raw_columns int, cleaned_rows long, cleaned_columns int, "
                                 "rows_removed long, rows_removed_pct double, default_count long, "
                                 "non_default_count long, default_rate_pct double")


@register("b8_feature_job_sink", OM.TEST_YEAR_FEATURES)
def b8_feature_job_sink(spark, d):
    """B8 end to end: cleaned table written, features written partitioned by year, pruned read back."""
    from pdforge.plans.cleaning_job import write_cleaning_job, write_feature_job
    cleaned_path, feat_path = scratch_path(spark, "loans_cleaned"), scratch_path(spark, "features")
    write_cleaning_job(raw(spark, d), cleaned_path)
    write_feature_job(cleaned_path, feat_path, spark)
    back = spark.read.parquet(feat_path).where(F.col("issue_year") == K.FIXTURE_TEST_YEAR)
    return back.withColumn("issue_year", F.col("issue_year").cast("smallint"))
