"""Model operators (T1-T10) on MLlib.

* Preprocessing (T1, T2): StringIndexer(handleInvalid='keep') + OneHotEncoder
  (unseen / null -> all-zero vector), VectorAssembler, StandardScaler on the
  numeric block only.
* Baseline (T3): LogisticRegression with balanced class weights
  (w = n / (2 n_class)) and regParam = 1 / (C * sum w), i.e. the same
  objective as an L2 model with inverse strength C.
* Challenger (T4): boosted trees (``boosting.BoostedTrees``, MLlib's GBTClassifier
  trained over binned columns) with the boosted-tree defaults mapped to MLlib (depth for leaves, minInstancesPerNode for min child samples,
  subsampling, feature subset, positive-class weight neg/pos).
* Thresholds, metrics, champion (T7), tuning (T8/T9): scores are columns of
  DataFrames; metrics come from the distributed curve operators.

Training is distributed: MLlib's optimisers (treeAggregate per iteration) and
the passes of ``boosting``; nothing is collected except model coefficients,
sums a tree level and one-row metrics.
"""

from __future__ import annotations

import json
import math
import random
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pdforge import constants as K
from pdforge.operators import metrics as M
from pdforge.operators.boosting import BoostedTrees
from pdforge.operators.columns import split_feature_types

LABEL = "label"
WEIGHT = "weight"


@dataclass
class ModelSpec:
    numeric: list
    categorical: list
    filled: list = field(default_factory=list)  # numeric columns that get a missing indicator
    max_levels: int = 0  # of the categorical columns, null included


def model_frame(features: DataFrame, label: str = "target") -> DataFrame:
    """Features with ``label`` (int) and without text / split-only columns."""
    drop = [c for c in ("emp_title",) if c in features.columns]
    return features.drop(*drop).withColumn(LABEL, F.col(label).cast("int"))


def spread(df: DataFrame, key: str = "loan_id", rows: int = 1_000_000) -> DataFrame:
    """``df`` in parts by hash of ``key``: one a core at least, of about ``rows`` rows at most. The iterations of a fit
    run a task a part, so a few files left by small joins would leave cores idle in every one of them."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(parts, F.col(key)).sortWithinPartitions(key)


def infer_spec(df: DataFrame, exclude=("loan_id", "target", "issue_year", "split", LABEL, WEIGHT, "fold", "pd")) -> ModelSpec:
    num, cat = split_feature_types(df, exclude=exclude)
    row = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in num]).first()  # one row
    levels = [r["n"] for r in reduce(DataFrame.unionAll, [df.groupBy(c).count().agg(F.count(F.lit(1)).alias("n")) for c in cat]).collect()] if cat else []
    return ModelSpec(num, cat, [c for c in num if row[c] > 0], max(levels, default=0))


def fill_missing(df: DataFrame, spec: ModelSpec) -> DataFrame:
    """Nulls left after cleaning: 0 plus an indicator column (MLlib vectors take no nulls)."""
    cols = {}
    for c in spec.filled:
        cols[f"{c}_missing"] = F.col(c).isNull().cast("double")
        cols[c] = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return df.withColumns(cols) if cols else df


def numeric_inputs(spec: ModelSpec) -> list:
    return list(spec.numeric) + [f"{c}_missing" for c in spec.filled]


def balanced_weights(df: DataFrame) -> tuple[DataFrame, float]:
    """T3 weights n / (2 n_class); returns the frame and the weight total."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(LABEL)).alias("pos")).first()
    n, pos = row["n"], row["pos"] or 0
    neg = n - pos
    w1 = n / (2.0 * pos) if pos else 0.0
    w0 = n / (2.0 * neg) if neg else 0.0
    return df.withColumn(WEIGHT, F.when(F.col(LABEL) == 1, w1).otherwise(w0)), float(n)


def positive_weight(df: DataFrame) -> tuple[DataFrame, float]:
    """T4 weights: positives neg/pos (A13), negatives 1."""
    row = df.agg(F.sum(1 - F.col(LABEL)).alias("neg"), F.sum(F.col(LABEL)).alias("pos")).first()
    ratio = float(row["neg"]) / float(row["pos"]) if row["pos"] else 1.0
    return df.withColumn(WEIGHT, F.when(F.col(LABEL) == 1, ratio).otherwise(1.0)), ratio


def _indexers(spec: ModelSpec):
    if not spec.categorical:
        return [], []
    idx = [f"{c}_idx" for c in spec.categorical]
    return [StringIndexer(inputCols=spec.categorical, outputCols=idx, handleInvalid="keep",
                          stringOrderType="frequencyDesc")], idx


def lr_pipeline(spec: ModelSpec, C: float = 1.0, max_iter: int = K.LR_MAX_ITER, weight_total: float = 1.0) -> Pipeline:
    """T1 + T2 + T3."""
    stages, idx = _indexers(spec)
    ohe = [f"{c}_ohe" for c in spec.categorical]
    if spec.categorical:
        stages.append(OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True, handleInvalid="keep"))
    stages += [VectorAssembler(inputCols=numeric_inputs(spec), outputCol="_num"),
               StandardScaler(inputCol="_num", outputCol="_num_std", withMean=True, withStd=True),
               VectorAssembler(inputCols=["_num_std"] + ohe, outputCol="features"),
               LogisticRegression(featuresCol="features", labelCol=LABEL, weightCol=WEIGHT, maxIter=max_iter,
                                  regParam=1.0 / (C * weight_total), elasticNetParam=0.0, standardization=False)]
    return Pipeline(stages=stages)


def gbt_pipeline(spec: ModelSpec, params: dict | None = None, seed: int = K.RANDOM_SEED,
                 validation_col: str | None = None) -> Pipeline:
    """T4 (+ T6 when ``validation_col`` is given: MLlib early stopping on that set)."""
    p = dict(K.GBT_DEFAULTS)
    p.update(params or {})
    depth = int(p.get("max_depth") or max(2, min(8, round(math.log2(max(2, p["num_leaves"]))))))
    stages, idx = _indexers(spec)
    stages.append(VectorAssembler(inputCols=numeric_inputs(spec) + idx, outputCol="features"))
    gbt = BoostedTrees(featuresCol="features", labelCol=LABEL, weightCol=WEIGHT, maxIter=int(p["n_estimators"]),
                       stepSize=float(p["learning_rate"]), maxDepth=depth,
                       minInstancesPerNode=int(p["min_child_samples"]), subsamplingRate=float(p["subsample"]),
                       featureSubsetStrategy=str(float(p["colsample_bytree"])), maxBins=max(64, spec.max_levels + 1), seed=seed)
    if validation_col:
        gbt = gbt.setValidationIndicatorCol(validation_col)
    stages.append(gbt)
    return Pipeline(stages=stages)


def predict_pd(model: PipelineModel, df: DataFrame, out: str = "pd", keep: tuple = ()) -> DataFrame:
    """T5: probability of class 1 as a double column, beside ``keep`` of the pipeline's own columns."""
    pred = model.transform(df)
    return pred.select(*df.columns, *keep, vector_to_array("probability")[1].alias(out))


@dataclass
class TrainedModel:
    name: str
    model: PipelineModel
    spec: ModelSpec
    threshold: float
    val_metrics: dict
    test_metrics: dict | None = None

    def metadata(self) -> dict:
        return {"name": self.name, "numerical_features": self.spec.numeric,
                "categorical_features": self.spec.categorical, "filled_features": self.spec.filled,
                "threshold": self.threshold, "val_metrics": self.val_metrics, "test_metrics": self.test_metrics}


def _labelled(pred: DataFrame) -> DataFrame:
    return pred.select(F.col(LABEL).alias("label"), F.col("pd").alias("score"))


def evaluate(model: PipelineModel, df: DataFrame, threshold: float) -> dict:
    """M9 for a fitted model on a frame."""
    pred = predict_pd(model, df)
    return M.metric_bundle(_labelled(pred), threshold).first().asDict()


def fit_and_calibrate(name: str, pipeline: Pipeline, spec: ModelSpec, train: DataFrame, val: DataFrame) -> TrainedModel:
    model = pipeline.fit(train)
    t, bundle = M.calibrate(_labelled(predict_pd(model, val)))
    return TrainedModel(name, model, spec, t, bundle.first().asDict())


def evaluate_together(models: list, test: DataFrame):
    """Test metrics of several fitted models at their own thresholds: their scores share one curve pass."""
    scored = [_labelled(predict_pd(m.model, fill_missing(test, m.spec))).select(F.lit(i).alias("model"), F.lit("test").alias("split"), "*")
              for i, m in enumerate(models)]
    rows = M.evaluate_models(reduce(DataFrame.unionByName, scored), thresholds={i: m.threshold for i, m in enumerate(models)}).collect()
    for r in rows:  # one row a model
        models[r["model"]].test_metrics = {c: r[c] for c in M.BUNDLE}


def train_logistic_regression(train: DataFrame, val: DataFrame, spec: ModelSpec, C: float = 1.0,
                              max_iter: int = K.LR_MAX_ITER) -> TrainedModel:
    """Fit on train, Youden threshold on validation."""
    train_w, total = balanced_weights(fill_missing(train, spec))
    return fit_and_calibrate("Logistic Regression", lr_pipeline(spec, C, max_iter, total), spec,
                             train_w, fill_missing(val, spec))


def train_gbt(train: DataFrame, val: DataFrame, spec: ModelSpec, params: dict | None = None,
              seed: int = K.RANDOM_SEED) -> TrainedModel:
    """T4 (+ T10: tuned params override the defaults, the class weight is always recomputed)."""
    train_w, _ = positive_weight(fill_missing(train, spec))
    return fit_and_calibrate("Gradient-Boosted Trees", gbt_pipeline(spec, params, seed), spec,
                             train_w, fill_missing(val, spec))


def champion(models: list) -> TrainedModel:
    """Best test ROC-AUC; ties go to the boosted trees (listed first)."""
    best = None
    for m in models:
        auc = (m.test_metrics or {}).get("roc_auc") or 0.0
        if best is None or auc > ((best.test_metrics or {}).get("roc_auc") or 0.0):
            best = m
    return best


def save_model(m: TrainedModel, path: str):
    """MLlib model directory plus a one-row JSON metadata table."""
    from pyspark.sql import SparkSession
    m.model.write().overwrite().save(f"{path}/model")
    s = SparkSession.getActiveSession()
    s.createDataFrame([(json.dumps(m.metadata()),)], "metadata string").coalesce(1) \
        .write.mode("overwrite").json(f"{path}/metadata")


def load_model(path: str) -> TrainedModel:
    """S13."""
    from pyspark.sql import SparkSession
    s = SparkSession.getActiveSession()
    meta = json.loads(s.read.json(f"{path}/metadata").first()["metadata"])
    spec = ModelSpec(meta["numerical_features"], meta["categorical_features"], meta.get("filled_features", []))
    return TrainedModel(meta["name"], PipelineModel.load(f"{path}/model"), spec, meta["threshold"],
                        meta["val_metrics"], meta.get("test_metrics"))


# ---------------------------------------------------------------------------
# tuning
# ---------------------------------------------------------------------------
def lr_param_draws(n_iter: int = 30, seed: int = K.RANDOM_SEED) -> list[dict]:
    """Seeded draws: C log-uniform over the range, iterations from the choices."""
    rng = random.Random(seed)
    lo, hi = math.log(K.LR_C_RANGE[0]), math.log(K.LR_C_RANGE[1])
    return [{"C": math.exp(rng.uniform(lo, hi)), "max_iter": rng.choice(K.LR_MAX_ITER_CHOICES)}
            for _ in range(n_iter)]


def tune_logistic_regression(cv_rows: DataFrame, spec: ModelSpec, n_iter: int = 30, folds: int = 5,
                             seed: int = K.RANDOM_SEED) -> tuple[dict, DataFrame]:
    """Random search with stratified folds (``fold`` column, W10), ROC-AUC.

    ``cv_rows`` are train+val rows. They are written once; all draws of all folds are fitted together, a pass over the rows
    a step, each fold with its own scaler and levels, and all held-out scores are counted together (``logistic_folds``).
    Returns the best parameters and a (C, max_iter, cv_auc) results frame.
    """
    from pdforge.operators import logistic_folds as LF
    from pdforge.operators.splits import stratified_folds
    from pdforge.session import materialize

    data, total = balanced_weights(fill_missing(cv_rows, spec))
    total_train = total * (folds - 1) / folds
    draws = lr_param_draws(n_iter, seed)
    stages, idx = _indexers(spec)
    levels = []
    if stages:
        indexer = stages[0].fit(data)
        data, levels = indexer.transform(data), [len(v) + 1 for v in indexer.labelsArray]
    data = stratified_folds(data, folds, label=LABEL, seed=seed)
    rows = materialize(data.select(
        "fold", F.array(*[F.col(c).cast("double") for c in numeric_inputs(spec)]).cast("array<double>").alias("x"),
        F.array(*[F.col(c).cast("int") for c in idx]).cast("array<int>").alias("c"),
        F.col(LABEL).cast("double").alias("y"), F.col(WEIGHT).cast("double").alias("w")), "tune_rows")
    design = LF.Design(rows, folds, levels)
    coefs = LF.fitted(rows, design, [1.0 / (d["C"] * total_train) for d in draws], [d["max_iter"] for d in draws])
    aucs = LF.held_out_aucs(rows, design, coefs)
    means = [sum(aucs[i, k] for k in range(folds)) / folds for i in range(len(draws))]
    spark = cv_rows.sparkSession
    res = spark.createDataFrame([(d["C"], d["max_iter"], m) for d, m in zip(draws, means)], "C double, max_iter int, cv_auc double")
    best = max(zip(draws, means), key=lambda t: t[1])[0]
    return best, res


#: Search space of the boosted trees: (kind, low, high). MLlib's trees have no L1 / L2 terms on leaf values.
GBT_SPACE = {"n_estimators": ("int", 100, 1000), "learning_rate": ("log", 0.01, 0.3), "num_leaves": ("int", 20, 150),
             "max_depth": ("int", 3, 12), "min_child_samples": ("int", 20, 200), "subsample": ("real", 0.5, 1.0),
             "colsample_bytree": ("real", 0.5, 1.0)}


def gbt_param_draws(n_trials: int = 50, seed: int = K.RANDOM_SEED, space: dict | None = None) -> list[dict]:
    """Seeded random draws over the boosted-tree search space."""
    rng = random.Random(seed)
    draw = {"int": rng.randint, "real": rng.uniform, "log": lambda a, b: math.exp(rng.uniform(math.log(a), math.log(b)))}
    return [{k: draw[kind](lo, hi) for k, (kind, lo, hi) in (space or GBT_SPACE).items()} for _ in range(n_trials)]


def save_params(spark, path: str, model: str, params: dict, score: float) -> int:
    """Appends a version of a model's best parameters to the parameter table; its number."""
    version = (latest_params(spark, path, model) or {"version": 0})["version"] + 1
    spark.createDataFrame([(model, version, json.dumps(params, sort_keys=True), float(score))], PARAMS_SCHEMA) \
        .coalesce(1).write.mode("append").parquet(path)
    return version


PARAMS_SCHEMA = "model string, version int, params string, score double"


def latest_params(spark, path: str, model: str) -> dict | None:
    """{version, params, score} of the newest parameters of a model; None where the table has none."""
    from pyspark.errors import AnalysisException
    try:
        table = spark.read.schema(PARAMS_SCHEMA).parquet(path)
    except AnalysisException:  # no table yet
        return None
    row = table.where(F.col("model") == model).orderBy(F.desc("version")).limit(1).collect()
    return {"version": row[0].version, "params": json.loads(row[0].params), "score": row[0].score} if row else None


def tune_gbt(train: DataFrame, val: DataFrame, spec: ModelSpec, n_trials: int = 50,
             seed: int = K.RANDOM_SEED, space: dict | None = None, parallelism: int = 4) -> tuple[dict, DataFrame]:
    """Fit each draw on train, score exact ROC-AUC on validation.

    Indexing and assembly are fitted and written once; the trials search over the trees alone and run as parallel Spark
    jobs from a few driver threads.
    """
    from multiprocessing.pool import ThreadPool

    from pyspark.util import inheritable_thread_target

    from pdforge.session import materialize

    train_w, _ = positive_weight(fill_missing(train, spec))
    draws = gbt_param_draws(n_trials, seed, space)
    front = Pipeline(stages=gbt_pipeline(spec, draws[0], seed).getStages()[:-1]).fit(train_w)
    fit_rows = materialize(front.transform(train_w).select("features", LABEL, WEIGHT), "tune_train")
    val_rows = materialize(front.transform(fill_missing(val, spec)).select("features", LABEL), "tune_val")

    def trial(p: dict) -> float:
        model = gbt_pipeline(spec, p, seed).getStages()[-1].fit(fit_rows)
        scored = model.transform(val_rows).select(F.col(LABEL).alias("label"), vector_to_array("probability")[1].alias("score"))
        return float(M.curve_metrics(M.curve_table(scored)).first()["roc_auc"])

    with ThreadPool(max(1, min(parallelism, len(draws)))) as pool:
        aucs = pool.map(inheritable_thread_target(trial), draws)
    results = [(i, json.dumps(p), auc) for i, (p, auc) in enumerate(zip(draws, aucs))]
    spark = train.sparkSession
    res = spark.createDataFrame(results, "trial int, params string, val_auc double")
    best = json.loads(max(results, key=lambda r: r[2])[1])
    return best, res

