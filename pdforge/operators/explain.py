"""Attribution (T11-T13) and its readers.

Linear models: phi_j = coef_j * (x_j - mean_j), a column expression; means
are one aggregate over the background rows (bounded: one scalar per feature).
Results are long form (loan_id, feature, phi, ...) so global importance is a
``groupBy(feature)`` with partial aggregation and per-loan top factors are a
per-row array sort (no shuffle).

Tree models: path-dependent Shapley values (the game of Lundberg et al., 2018)
over the fitted ensemble. Each piece of a tree (a subtree with the conditions
that lead to it) has a table of the values of its features for every pattern of
decisions; Arrow batches look the patterns up, a column of rows at a time. The
tables are broadcast once (their size is bounded by the model).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pdforge.session import scratch_path

#: Features of a path up to which a leaf keeps a table of all patterns; rows evaluated at once; decisions of a piece.
TABLE_FEATURES, SHAP_ROWS, PIECE_NODES = 8, 8192, 9


def _impact(phi):
    return (F.when(phi > 0, F.lit("increases_risk")).when(phi < 0, F.lit("decreases_risk"))
            .otherwise(F.lit("neutral")))


@dataclass
class LinearAttribution:
    coefs: dict
    means: dict
    intercept: float = 0.0
    columns: dict = field(default_factory=dict)  # feature -> expression the model reads; the column of that name by default
    shown: dict = field(default_factory=dict)  # feature -> expression to show

    @classmethod
    def fit(cls, background: DataFrame, coefs: dict, intercept: float = 0.0, columns: dict | None = None,
            shown: dict | None = None, flags: dict | None = None) -> "LinearAttribution":
        """Means of each feature over the background rows (exact decimal sums).

        ``flags`` (feature -> condition, never null) are features of 0 and 1: their sums are counts.
        """
        columns, flags = columns or {}, flags or {}
        aggs = [F.count(F.lit(1)).alias("n")]
        for i, c in enumerate(coefs):
            if c in flags:
                aggs.append(F.count_if(flags[c]).alias(f"s_{i}"))
                continue
            x = columns[c] if c in columns else F.col(c)
            aggs += [F.sum(x.cast("double").cast("decimal(28,8)")).alias(f"s_{i}"), F.count(x).alias(f"n_{i}")]
        row = background.agg(*aggs).first()  # one row of scalars
        counts = [row["n" if c in flags else f"n_{i}"] for i, c in enumerate(coefs)]
        means = {c: (float(row[f"s_{i}"]) / n) if n else 0.0 for i, (c, n) in enumerate(zip(coefs, counts))}
        return cls(dict(coefs), means, intercept, columns, shown or {})

    def base_value(self) -> float:
        return self.intercept + sum(self.coefs[c] * self.means[c] for c in self.coefs)

    def contributions(self) -> "F.Column":
        """Per-row array<struct<feature, ordinal, feature_value, phi>> (wide form)."""
        items = []
        for i, (c, w) in enumerate(self.coefs.items()):
            x = (self.columns[c] if c in self.columns else F.col(c)).cast("double")
            items.append(F.struct(F.lit(c).alias("feature"), F.lit(i).alias("ordinal"), self.shown.get(c, x).alias("feature_value"),
                                  (F.lit(w) * (x - F.lit(self.means[c]))).alias("phi")))
        return F.array(*items)

    def top_factors(self, rows: DataFrame, k: int = 5, key: str = "loan_id") -> DataFrame:
        """W6 on the wide form: sort each row's own array, no shuffle."""
        ranked = F.transform(self.contributions(),
                             lambda s: F.struct((-F.abs(s["phi"])).alias("neg_abs"), s["ordinal"].alias("ordinal"),
                                                s["feature"].alias("feature")))
        top = rows.select(key, F.posexplode(F.slice(F.array_sort(ranked), 1, k)).alias("pos", "s"))
        return top.select(key, (F.col("pos") + 1).cast("int").alias("factor_rank"), F.col("s.feature").alias("feature"))

    def explain(self, rows: DataFrame, key: str = "loan_id") -> DataFrame:
        """T12 + X26 + X27: (key, feature, ordinal, feature_value, phi, impact, display_value)."""
        long = rows.select(key, F.inline(self.contributions()))
        return long.withColumns({"impact": _impact(F.col("phi")),
                                 "display_value": F.format_string("%.2f", F.col("feature_value"))})


def mean_abs_attribution(attr: DataFrame) -> DataFrame:
    """Mean |phi| per feature (exact decimal sum, partial aggregation)."""
    return attr.groupBy("feature").agg(
        (F.sum(F.abs("phi").cast("decimal(28,12)")).cast("double") / F.count(F.lit(1))).alias("mean_abs_phi"))


def importance_ranking(imp: DataFrame) -> DataFrame:
    """Features by mean |phi| descending (window over one row per feature)."""
    w = Window.orderBy(F.desc("mean_abs_phi"), "feature")
    return imp.withColumn("importance_rank", F.row_number().over(w).cast("int")).orderBy("importance_rank")


def top_factors(attr: DataFrame, k: int = 5, key: str = "loan_id") -> DataFrame:
    """W6 on a long table: top-k factors per loan by |phi| (ties by feature order).

    Each loan's group is its own feature list (bounded by the model's width).
    Prefer ``LinearAttribution.top_factors`` (wide form, no shuffle) when the
    contributions are still in-row.
    """
    per_loan = attr.groupBy(key).agg(F.collect_list(F.struct(
        (-F.abs("phi")).alias("neg_abs"), F.col("ordinal"), F.col("feature"))).alias("f"))
    top = per_loan.select(key, F.posexplode(F.slice(F.array_sort("f"), 1, k)).alias("pos", "s"))
    return top.select(key, (F.col("pos") + 1).cast("int").alias("factor_rank"), F.col("s.feature").alias("feature"))


# ---------------------------------------------------------------------------
# TreeSHAP (path-dependent) for MLlib tree ensembles
# ---------------------------------------------------------------------------
def tree_tables(model) -> list[dict]:
    """Per tree: arrays (feature, threshold, left, right, value, cover), values already weighted.

    Read from the node table that a saved ensemble consists of: as many rows as the model has nodes.
    """
    spark = SparkSession.getActiveSession()
    path = scratch_path(spark, "trees")
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
    weights = list(model.treeWeights)
    if type(model).__name__.startswith("GBTClassification"):
        weights = [2.0 * w for w in weights]  # probability = 1 / (1 + exp(-2 margin)): log-odds are twice the margin
    trees = [[] for _ in weights]
    for n in nodes:
        trees[n.treeID].append(n)
    tables = []
    for w, own in zip(weights, trees):
        ordinal = [n.split.numCategories < 0 for n in own]
        tables.append({
            "feature": np.array([n.split.featureIndex if n.leftChild >= 0 else -1 for n in own]),
            "threshold": np.array([n.split.leftCategoriesOrThreshold[0] if n.leftChild >= 0 and o else 0.0 for n, o in zip(own, ordinal)]),
            "left": np.array([n.leftChild for n in own]), "right": np.array([n.rightChild for n in own]),
            "value": np.array([n.prediction for n in own]) * w, "cover": np.array([n.impurityStats[0] for n in own]),
            "cats": [None if o or n.leftChild < 0 else set(n.split.leftCategoriesOrThreshold) for n, o in zip(own, ordinal)]})
    return tables


def _leaf_phi(one: np.ndarray, zero: np.ndarray, value: float) -> np.ndarray:
    """Shapley values of one leaf: ``one`` (rows x features of its path) tells which features lead there, ``zero`` which
    share of the cover does.

    The game is a product over the features, each present (one) or averaged (zero), so a feature's value needs only the
    coefficients of the product of (zero_j + one_j t) over the others, weighted by |S|! (d - |S| - 1)! / d!.
    """
    n, d = one.shape
    weight = np.array([math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)])
    out = np.empty((n, d))
    for f in range(d):
        c = np.zeros((n, d))
        c[:, 0] = 1.0
        for j in range(d):
            if j != f:
                c[:, 1:] = c[:, 1:] * zero[j] + c[:, :-1] * one[:, [j]]
                c[:, 0] *= zero[j]
        out[:, f] = (c @ weight) * (one[:, f] - zero[f]) * value
    return out


def leaf_tables(tree: dict) -> list[tuple]:
    """Per leaf: (features, conditions as [(feature's place, node, whether left)], zero shares, value, table of all
    patterns or None where the path has more than ``TABLE_FEATURES`` features)."""
    left, right, cover = tree["left"], tree["right"], tree["cover"]
    out, stack = [], [(0, ())]
    while stack:
        j, path = stack.pop()
        if left[j] >= 0:
            stack += [(int(left[j]), (*path, (j, True))), (int(right[j]), (*path, (j, False)))]
            continue
        feats = sorted({int(tree["feature"][a]) for a, _ in path})
        zero, steps = np.ones(len(feats)), []
        for a, is_left in path:
            k = feats.index(int(tree["feature"][a]))
            zero[k] *= cover[left[a] if is_left else right[a]] / cover[a]
            steps.append((k, a, is_left))
        table = None
        if len(feats) <= TABLE_FEATURES:
            patterns = (np.arange(1 << len(feats))[:, None] >> np.arange(len(feats))[None, :]) & 1
            table = _leaf_phi(patterns.astype(float), zero, float(tree["value"][j]))
        out.append((feats, steps, zero, float(tree["value"][j]), table))
    return out


def tree_shap(tree: dict, leaves: list[tuple], x: np.ndarray, phi: np.ndarray) -> None:
    """Adds one tree's Shapley values of the rows ``x`` to ``phi``: the decisions of all nodes at once, then each leaf's
    pattern of met conditions and one look-up."""
    went = {}
    for j in np.flatnonzero(np.asarray(tree["left"]) >= 0).tolist():
        v = x[:, tree["feature"][j]]
        went[j] = np.isin(v, list(tree["cats"][j])) if tree["cats"][j] is not None else v <= tree["threshold"][j]
    for feats, steps, zero, value, table in leaves:
        if not feats:
            continue
        met = np.ones((len(x), len(feats)), dtype=bool)
        for k, j, is_left in steps:
            met[:, k] &= went[j] == is_left
        if table is not None:
            phi[:, feats] += table[met @ (1 << np.arange(len(feats)))]
        else:
            phi[:, feats] += _leaf_phi(met.astype(float), zero, value)


def piece_tables(tree: dict) -> tuple[list, list]:
    """The tree in pieces of at most ``PIECE_NODES`` decisions: ([(nodes, features, values of each feature by pattern)], the
    leaves whose path alone has more).

    A piece is a subtree and the nodes above it. Its table has a row for every pattern of decisions (a bit a node, the first
    node's the highest, set where the row goes left): the sums of its leaves' values.
    """
    left, right = tree["left"], tree["right"]
    leaves = {tuple((j, is_left) for _, j, is_left in leaf[1]): leaf for leaf in leaf_tables(tree)}

    def inside(j):
        return [j, *inside(int(left[j])), *inside(int(right[j]))] if left[j] >= 0 else []

    pieces, long, stack = [], [], [(0, ())]
    while stack:
        j, path = stack.pop()
        nodes = [a for a, _ in path] + inside(j)
        if len(nodes) > PIECE_NODES:
            if left[j] >= 0:
                stack += [(int(left[j]), (*path, (j, True))), (int(right[j]), (*path, (j, False)))]
            else:
                long.append(leaves[path])
            continue
        own = [leaf for way, leaf in leaves.items() if way[:len(path)] == path and leaf[0]]
        feats = sorted({f for leaf in own for f in leaf[0]})
        went = (np.arange(1 << len(nodes))[:, None] >> np.arange(len(nodes) - 1, -1, -1)) & 1 == 1
        values = np.zeros((1 << len(nodes), len(feats)))
        for fs, steps, zero, value, table in own:
            met = np.ones((len(went), len(fs)), dtype=bool)
            for k, a, is_left in steps:
                met[:, k] &= went[:, nodes.index(a)] == is_left
            found = table[met @ (1 << np.arange(len(fs)))] if table is not None else _leaf_phi(met.astype(float), zero, value)
            values[:, [feats.index(f) for f in fs]] += found
        if feats:
            pieces.append((nodes, feats, np.ascontiguousarray(values.T)))
    return pieces, long


def tree_shap_columns(tree: dict, pieces: list, long: list, x: np.ndarray, phi: np.ndarray) -> None:
    """``tree_shap`` by pieces; rows are columns of ``x`` and ``phi``."""
    went = {}
    for j in np.flatnonzero(tree["left"] >= 0).tolist():
        v = x[tree["feature"][j]]
        went[j] = np.isin(v, list(tree["cats"][j])) if tree["cats"][j] is not None else v <= tree["threshold"][j]
    for nodes, feats, values in pieces:
        pattern = np.zeros(x.shape[1], dtype=np.intp)
        for j in nodes:
            pattern <<= 1
            pattern |= went[j]
        for f, of in zip(feats, values):
            phi[f] += of[pattern]
    for feats, steps, zero, value, table in long:
        met = np.ones((x.shape[1], len(feats)), dtype=bool)
        for k, j, is_left in steps:
            met[:, k] &= went[j] == is_left
        phi[feats] += (table[met @ (1 << np.arange(len(feats)))] if table is not None else _leaf_phi(met.astype(float), zero, value)).T


def expected_value(tree: dict) -> float:
    """Cover-weighted mean leaf value of one tree."""
    left, right, value, cover = tree["left"], tree["right"], tree["value"], tree["cover"]
    tot = 0.0
    for j in range(len(left)):
        if left[j] < 0:
            tot += value[j] * cover[j] / cover[0]
    return tot


def tree_shap_frame(rows: DataFrame, model, feature_names: list[str], features_col: str = "features",
                    key: str = "loan_id") -> DataFrame:
    """Long-form (key, feature, phi) plus (key, '__base__', base value) per row.

    ``model`` is a fitted GBTClassificationModel / tree model; its log-odds (the
    prediction of other tree models) are base + sum(phi). Runs over Arrow batches; nothing is evaluated row by row.
    """
    from pyspark.ml.functions import vector_to_array

    trees = tree_tables(model)
    base = float(sum(expected_value(t) for t in trees))
    names = [*feature_names, "__base__"]
    src = rows.select(F.col(key).alias("key"), vector_to_array(features_col).alias("x"))
    shared = rows.sparkSession.sparkContext.broadcast([(t, *piece_tables(t)) for t in trees])  # size fixed by the model

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(0, len(batch), SHAP_ROWS):
                part = batch.slice(k, SHAP_ROWS)
                x = np.ascontiguousarray(part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(part), len(names) - 1).T)
                phi = np.zeros((len(names), len(part)))
                phi[-1] = base
                for t, pieces, long in shared.value:
                    tree_shap_columns(t, pieces, long, x, phi)
                ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * len(names))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.ListArray.from_arrays(ends, pa.array(phi.T.ravel()))], names=["key", "phi"])

    wide = src.mapInArrow(run, T.StructType([src.schema["key"], T.StructField("phi", T.ArrayType(T.DoubleType()))]))
    return wide.select("key", F.posexplode("phi").alias("at", "phi")) \
        .select(F.col("key").alias(key), F.element_at(F.array(*[F.lit(n) for n in names]), F.col("at") + 1).alias("feature"), "phi")
