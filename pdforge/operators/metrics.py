"""Ranking-quality operators over a (label, score) DataFrame.

Plan: ``groupBy(by, score)`` -> (pos, neg) per distinct score (partial
aggregation: a score shared by a third of the rows is one row per task), then
the two-level prefix sums give, for each distinct score in descending order,
the positives / negatives strictly above it. Every metric is one aggregate
over that curve table — no collect of scores, no single-partition window.

``by`` names the models and splits to keep apart: any number of them share the
one scoring pass and the one shuffle (``evaluate_models``). Confusion counts at
a threshold come from the same grouped scores, so rows are scored once.

Exactness: AUC and KS are computed from integer counts (one division at the
end), Youden compares ``tp*N - fp*P`` as integers, PR-AUC sums decimal terms,
so results do not depend on partitioning or row order. Scores are taken as they
are: no rounding merges neighbouring thresholds.

Rows without a label or a score count nowhere; an empty group has no row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pdforge.operators.stats import prefix_sums
from pdforge.session import materialize

INF = float("inf")
#: The columns of a metric bundle, in order.
BUNDLE = ["roc_auc", "pr_auc", "gini", "ks_stat_pct", "accuracy", "default_precision", "default_recall", "default_f1",
          "threshold"]


def score_groups(df: DataFrame, label: str = "label", score: str = "score", by: tuple = ()) -> DataFrame:
    """(by, score, pos, neg): labels per distinct score, written once for the steps that follow."""
    g = (df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
         .groupBy(*by, F.col(score).cast("double").alias("score"))
         .agg(F.count(F.when(F.col(label) == 1, 1)).alias("pos"),
              F.count(F.when(F.col(label) != 1, 1)).alias("neg")))
    return materialize(g, "score_groups")


def running_counts(groups: DataFrame, by: tuple = (), **kw) -> DataFrame:
    """W1 from grouped scores: tp/fp before and inclusive per distinct score (descending), and each group's P, N."""
    by = list(by)
    totals = groups.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.count(F.lit(1)).alias("D"))
    rows = totals.collect()  # one row a model and split
    kw.setdefault("n_max", max([r["D"] for r in rows], default=0))
    c = prefix_sums(groups, by, "score", ["pos", "neg"], descending=True, **kw)
    if by:
        held = groups.sparkSession.createDataFrame(rows, totals.schema).drop("D") if rows else totals.drop("D")
        held = held.select(*[F.col(k).alias(f"_t_{k}") for k in by], "P", "N")
        same = reduce(lambda x, y: x & y, [c[k].eqNullSafe(held[f"_t_{k}"]) for k in by])  # a null group is a group
        c = c.join(F.broadcast(held), same)
    else:
        P, N = ((rows[0]["P"] or 0, rows[0]["N"] or 0) if rows else (0, 0))
        c = c.withColumns({"P": F.lit(int(P)).cast("bigint"), "N": F.lit(int(N)).cast("bigint")})
    return c.select(*by, "score", "pos", "neg",
                    F.col("pos_before").alias("tp_before"), F.col("neg_before").alias("fp_before"),
                    (F.col("pos_before") + F.col("pos")).alias("tp"),
                    (F.col("neg_before") + F.col("neg")).alias("fp"), "P", "N")


def curve_table(df: DataFrame, label: str = "label", score: str = "score", by: tuple = (), **kw) -> DataFrame:
    """Per group and distinct score (descending): pos, neg, tp/fp before and inclusive, P, N."""
    return running_counts(score_groups(df, label, score, by), by, **kw)


def roc_points(curve: DataFrame) -> DataFrame:
    """M1: (threshold, tp, fp, tpr, fpr) for every distinct score, plus the (inf, 0, 0) start."""
    pts = curve.select(F.col("score").alias("threshold"), "tp", "fp", "P", "N")
    P_N = curve.select("P", "N").limit(1)
    start = P_N.select(F.lit(INF).alias("threshold"), F.lit(0).cast("bigint").alias("tp"),
                       F.lit(0).cast("bigint").alias("fp"), "P", "N")
    out = pts.unionByName(start)
    return out.select("threshold", "tp", "fp",
                      (F.col("tp") / F.col("P")).alias("tpr"), (F.col("fp") / F.col("N")).alias("fpr"))


def pr_points(curve: DataFrame) -> DataFrame:
    """M2: (threshold, precision, recall) per distinct score, plus the closing (recall 0, precision 1)."""
    pts = curve.select(F.col("score").alias("threshold"),
                       (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                       (F.col("tp") / F.col("P")).alias("recall"))
    end = curve.limit(1).select(F.lit(None).cast("double").alias("threshold"),
                                F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


def _prev_precision():
    seen = F.col("tp_before") + F.col("fp_before")
    return F.when(seen == 0, F.lit(1.0)).otherwise(F.col("tp_before") / seen)


def curve_metrics(curve: DataFrame, by: tuple = ()) -> DataFrame:
    """One row a group: roc_auc, pr_auc, ks_stat_pct, gini, youden_threshold, youden_j, P, N."""
    # products of counts pass 64 bits from about 3e9 rows a class on
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    j = wide("tp") * wide("N") - wide("fp") * wide("P")
    pr_term = (F.col("pos") / F.col("P")) * (F.col("tp") / (F.col("tp") + F.col("fp")) + _prev_precision()) / 2.0
    agg = curve.groupBy(*by).agg(
        F.first("P").alias("P"), F.first("N").alias("N"),
        F.sum((wide("neg") * (2 * wide("tp_before") + wide("pos"))).cast("decimal(38,0)")).alias("_auc2"),
        F.sum(F.when(F.col("pos") > 0, pr_term.cast("decimal(38,12)"))).alias("_pr"),
        F.max(F.abs(j)).alias("_ks"),
        F.max(j).alias("_jmax"),
        F.max_by("score", F.struct(j, F.col("score"))).alias("_jscore"),
    )
    auc = F.col("_auc2").cast("double") / (2.0 * F.col("P").cast("double") * F.col("N").cast("double"))
    both = (F.col("P") > 0) & (F.col("N") > 0)
    return agg.select(
        *by,
        F.when(both, auc).alias("roc_auc"),
        F.when(F.col("P") > 0, F.coalesce(F.col("_pr").cast("double"), F.lit(0.0))).alias("pr_auc"),
        F.when(both, F.col("_ks").cast("double") / (F.col("P").cast("double") * F.col("N")) * 100.0)
        .otherwise(F.lit(0.0)).alias("ks_stat_pct"),
        F.when(both, 2.0 * auc - 1.0).alias("gini"),
        F.when(F.col("_jmax") > 0, F.col("_jscore")).otherwise(F.lit(INF)).alias("youden_threshold"),
        F.when(both, F.greatest(F.col("_jmax").cast("double"), F.lit(0.0))
               / (F.col("P").cast("double") * F.col("N"))).alias("youden_j"),
        "P", "N",
    )


def _with_rates(counts: DataFrame) -> DataFrame:
    """accuracy, precision, recall and F1 of class 1 beside (tp, fp, tn, fn)."""
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    out = counts.select("*", ((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")))
                        .alias("accuracy"), p.alias("precision"), r.alias("recall"))
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                       2 * F.col("precision") * F.col("recall")
                                       / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def confusion(df: DataFrame, threshold: float, label: str = "label", score: str = "score") -> DataFrame:
    """M8 + F6/F7: counts at ``score >= threshold`` and accuracy / precision / recall / F1 of class 1."""
    pred = F.col(score) >= F.lit(threshold)
    y = F.col(label) == 1
    return _with_rates(df.where(F.col(label).isNotNull()).agg(
        F.count_if(pred & y).alias("tp"), F.count_if(pred & ~y).alias("fp"),
        F.count_if(~pred & ~y).alias("tn"), F.count_if(~pred & y).alias("fn")))


def confusion_of_groups(groups: DataFrame, threshold, by: tuple = ()) -> DataFrame:
    """M8 from grouped scores: the same counts without another look at the rows."""
    pred = F.col("score") >= threshold
    total = lambda rows, c: F.coalesce(F.sum(F.when(rows, F.col(c))), F.lit(0))
    return _with_rates(groups.groupBy(*by).agg(
        total(pred, "pos").alias("tp"), total(pred, "neg").alias("fp"),
        total(~pred, "neg").alias("tn"), total(~pred, "pos").alias("fn")))


def youden_threshold(df: DataFrame, label: str = "label", score: str = "score") -> float:
    """M7 as a scalar (for use as a parameter of later jobs)."""
    return curve_metrics(curve_table(df, label, score)).first()["youden_threshold"]


def _bundle_columns() -> list:
    """M9's rounded columns (4 places, KS 2) over curve metrics, rates and ``threshold``."""
    named = {"default_precision": "precision", "default_recall": "recall", "default_f1": "f1"}
    return [F.round(named.get(c, c), 2 if c == "ks_stat_pct" else 4).alias(c) for c in BUNDLE]


def evaluate_models(scores: DataFrame, by: tuple = ("model",), thresholds: dict | None = None, split: str = "split",
                    fit: str = "val", report: tuple = ("test",), label: str = "label", score: str = "score") -> DataFrame:
    """M9 for all models and splits of ``scores`` (by, split, label, score): one row per model and reported split.

    One pass over the rows: the scores are grouped once, every curve is a group of the same running sums, each model's
    threshold is the Youden cut of its own ``fit`` split (or given in ``thresholds``, by the first of ``by``), and the
    confusion counts are read from the grouped scores. A model without a ``fit`` split has no threshold: its rates
    and threshold are null, its curve metrics stand.
    """
    keys = [*by, split]
    groups = score_groups(scores, label, score, keys)
    found = curve_metrics(running_counts(groups, keys), keys).collect()  # one row a model and split
    cut = {tuple(r[k] for k in by): r["youden_threshold"] for r in found if r[split] == fit}
    if thresholds is not None:
        cut = {tuple(r[k] for k in by): thresholds.get(r[by[0]]) for r in found}
    kinds = {f.name: f.dataType.simpleString() for f in groups.schema}
    names = [*keys, "roc_auc", "pr_auc", "gini", "ks_stat_pct", "threshold"]
    held = groups.sparkSession.createDataFrame(
        [(*[r[c] for c in names[:-1]], cut.get(tuple(r[k] for k in by))) for r in found if r[split] in report],
        ", ".join(f"`{c}` {kinds.get(c, 'double')}" for c in names))
    held = held.select(*[F.col(k).alias(f"_t_{k}") for k in keys], *names[len(keys):])
    same = reduce(lambda x, y: x & y, [groups[k].eqNullSafe(held[f"_t_{k}"]) for k in keys])
    measured = [*keys, *names[len(keys):]]
    joined = groups.join(F.broadcast(held), same)  # one row a model and split
    rates = confusion_of_groups(joined, F.col("threshold"), measured)
    judged = F.col("threshold").isNotNull()
    blank = {c: F.when(judged, F.col(c)) for c in ("accuracy", "precision", "recall", "f1")}
    return rates.withColumns(blank).select(*keys, *_bundle_columns())


def calibrate(df: DataFrame, label: str = "label", score: str = "score", threshold: float | None = None) -> tuple:
    """(threshold, M9 as one row): the Youden cut (M7) where no threshold is given. Rows are read once for both."""
    groups = score_groups(df, label, score)
    m = curve_metrics(running_counts(groups)).first()  # one row of scalars
    t = float(m["youden_threshold"] if threshold is None else threshold)
    out = confusion_of_groups(groups, F.lit(t))
    return t, out.withColumns({**{c: F.lit(m[c]).cast("double") for c in ("roc_auc", "pr_auc", "gini", "ks_stat_pct")},
                               "threshold": F.lit(t)}).select(*_bundle_columns())


def metric_bundle(df: DataFrame, threshold: float, label: str = "label", score: str = "score") -> DataFrame:
    """M9: one row of rounded metrics (4 places, KS 2) at a given threshold."""
    return calibrate(df, label, score, threshold)[1]


def metrics_long(bundles: DataFrame, model: str = "model") -> DataFrame:
    """Bundle rows -> (model, metric, value) rows for comparisons."""
    arr = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in BUNDLE])
    return bundles.select(F.col(model).alias("model"), F.inline(arr))


def compare_models(bundles: DataFrame, baseline: str = "baseline", challenger: str = "challenger",
                   model: str = "model") -> DataFrame:
    """Metric-by-metric comparison of two bundle rows with delta = round(challenger - baseline, 4)."""
    of = lambda name: F.max(F.when(F.col("model") == name, F.col("value")))
    both = metrics_long(bundles, model).groupBy("metric").agg(of(baseline).alias("baseline"), of(challenger).alias("challenger"))
    return both.withColumn("delta", F.round(F.col("challenger") - F.col("baseline"), 4))
