"""A saved model as column expressions.

``load_model`` gives the fitted pipeline and its metadata; ``compile_model`` turns indexer maps, one-hot positions, scaler
and coefficients, or the trees' node table, into one log-odds expression. Batch scoring, applications and streams then
stay projections without a Python worker, and the same saved champion serves all of them with its own name and threshold.
Frames of rows are scored by ``score``: hundreds of trees are interpreted as an expression, so there the ensemble's own
transformer walks them, over the same inputs.

A numeric input that is null counts as 0 (with its missing indicator where the model has one); a level that the model has
not seen takes the indexer's extra place, as in MLlib.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import OneHotEncoderModel, StandardScalerModel, StringIndexerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pdforge.operators import explain as EX
from pdforge.operators import models as MD


@dataclass
class Term:
    """One input of the model: what it adds to the log-odds is ``coef`` times ``value``."""

    feature: str
    value: Column
    shown: Column
    coef: float
    holds: Column | None = None  # of a level: whether the row has it


@dataclass
class CompiledModel:
    name: str
    threshold: float
    log_odds: Column
    terms: list | None = None  # of linear models
    intercept: float = 0.0
    trees: object = None  # the fitted ensemble, of trees
    inputs: list | None = None  # SQL texts of what it reads, in order

    def pd(self) -> Column:
        return _probability(self.log_odds)

    def score(self, df: DataFrame, out: str = "pd") -> DataFrame:
        if self.trees is None:
            return df.withColumn(out, self.pd())
        walker = self.trees.copy({self.trees.featuresCol: INPUTS, self.trees.rawPredictionCol: MARGIN, self.trees.predictionCol: "",
                                  self.trees.probabilityCol: ""})
        x = array_to_vector(F.array(*[F.expr(f"cast({t} as double)") for t in self.inputs]))
        scored = walker.transform(df.withColumn(INPUTS, x))
        return scored.withColumn(out, _probability(F.lit(2.0) * vector_to_array(MARGIN)[1])).drop(INPUTS, MARGIN)


#: Columns of a frame while its rows are scored.
INPUTS, MARGIN = "_tree_inputs", "_tree_margin"


def _probability(log_odds: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-log_odds))


def _stage(pipeline, kind):
    return next((s for s in pipeline.stages if isinstance(s, kind)), None)


def numeric_columns(spec) -> list[tuple[str, Column, Column]]:
    """(input, value as the model reads it, value to show), in the assembler's order."""
    own = [(c, F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.col(c).cast("double")) for c in spec.numeric]
    return own + [(f"{c}_missing", m, m) for c in spec.filled for m in [F.col(c).isNull().cast("double")]]


def _levels(pipeline, spec) -> dict[str, list[str]]:
    indexer = _stage(pipeline, StringIndexerModel)
    return dict(zip(spec.categorical, [list(x) for x in indexer.labelsArray])) if indexer else {}


def linear_terms(trained: MD.TrainedModel) -> tuple[float, list[Term]]:
    """Intercept and terms of a logistic pipeline, one a numeric input and one a level."""
    spec, pipeline = trained.spec, trained.model
    lr, scaler, hot = _stage(pipeline, LogisticRegressionModel), _stage(pipeline, StandardScalerModel), _stage(pipeline, OneHotEncoderModel)
    coefs = lr.coefficients.toArray().tolist()
    mean, std = scaler.mean.toArray().tolist(), scaler.std.toArray().tolist()
    terms = []
    for i, (name, value, shown) in enumerate(numeric_columns(spec)):
        scaled = (value - F.lit(mean[i])) / F.lit(std[i]) if std[i] else F.lit(0.0)
        terms.append(Term(name, scaled, shown, coefs[i]))
    at, levels = len(terms), _levels(pipeline, spec)
    for k, c in enumerate(spec.categorical):
        size, text = hot.categorySizes[k], F.col(c).cast("string")
        for j in range(size):
            holds = text.eqNullSafe(F.lit(levels[c][j])) if j < len(levels[c]) else ~F.coalesce(text.isin(levels[c]), F.lit(False))
            one = holds.cast("double")
            terms.append(Term(f"{c}={levels[c][j] if j < len(levels[c]) else '(other)'}", one, one, coefs[at + j], holds))
        at += size
    if at != len(coefs):
        raise ValueError(f"the model has {len(coefs)} coefficients, its pipeline {at} inputs")
    return float(lr.intercept), terms


def _linear_log_odds(trained: MD.TrainedModel) -> Column:
    """Intercept, scaled inputs, and one look-up a categorical column."""
    intercept, terms = linear_terms(trained)
    n, spec = len(numeric_columns(trained.spec)), trained.spec
    out = F.lit(intercept)
    for t in terms[:n]:
        out = out + F.lit(t.coef) * t.value
    hot, levels = _stage(trained.model, OneHotEncoderModel), _levels(trained.model, spec)
    for k, c in enumerate(spec.categorical):
        coefs = [t.coef for t in terms[n:n + hot.categorySizes[k]]]
        n += hot.categorySizes[k]
        pairs = [x for level, w in zip(levels[c], coefs) for x in (F.lit(level), F.lit(w))]
        other = coefs[len(levels[c])] if len(levels[c]) < len(coefs) else 0.0
        look = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(c).cast("string")), F.lit(other)) if pairs else F.lit(other)
        out = out + look
    return out


def _text(s: str) -> str:
    """A string as SQL text, whatever characters it holds."""
    return f"cast(X'{s.encode().hex()}' as string)"


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _input_texts(trained: MD.TrainedModel) -> list[str]:
    """The inputs of a tree as SQL text: ``numeric_columns``, then the place of each categorical column's level among the
    fitted ones (the next place where it is unseen or null)."""
    spec = trained.spec
    out = [f"coalesce(cast({_name(c)} as double), 0.0D)" for c in spec.numeric]
    out += [f"cast({_name(c)} is null as double)" for c in spec.filled]
    for c, levels in _levels(trained.model, spec).items():
        pairs = ", ".join(f"{_text(level)}, {i}" for i, level in enumerate(levels))
        out.append(f"coalesce(try_element_at(map({pairs}), cast({_name(c)} as string)), {len(levels)})" if levels else "0")
    return out


def _tree_log_odds(trained: MD.TrainedModel) -> Column:
    """Sum over the trees of nested conditions on the inputs.

    The trees are one SQL text, parsed at once: hundreds of trees as single column calls take a minute on the driver. The
    inputs are worked out once a row; the conditions read them.
    """
    def node(t, j):
        if t["left"][j] < 0:
            return f"{float(t['value'][j])!r}D"
        x, cats = f"x.f{int(t['feature'][j])}", t["cats"][j]
        test = f"{x} in ({', '.join(str(int(c)) for c in sorted(cats))})" if cats is not None else f"{x} <= {float(t['threshold'][j])!r}D"
        return f"if({test}, {node(t, t['left'][j])}, {node(t, t['right'][j])})"

    inputs = ", ".join(f"'f{i}', {x}" for i, x in enumerate(_input_texts(trained)))
    trees = ", ".join(node(t, 0) for t in EX.tree_tables(trained.model.stages[-1]))
    return F.expr(f"transform(array(named_struct({inputs})), x -> aggregate(array({trees}), 0.0D, (a, b) -> a + b))[0]")


def compile_model(trained: MD.TrainedModel) -> CompiledModel:
    if _stage(trained.model, LogisticRegressionModel) is not None:
        intercept, terms = linear_terms(trained)
        return CompiledModel(trained.name, trained.threshold, _linear_log_odds(trained), terms, intercept)
    return CompiledModel(trained.name, trained.threshold, _tree_log_odds(trained), trees=trained.model.stages[-1], inputs=_input_texts(trained))


def load_compiled(path: str) -> CompiledModel:
    """The model saved at ``path`` (S12), ready to score."""
    return compile_model(MD.load_model(path))


def linear_attribution(model: CompiledModel, background: DataFrame) -> EX.LinearAttribution:
    """T12 for a fitted model: every scaled input and every level is a term; their means come from ``background``."""
    names = [t.feature for t in model.terms]
    return EX.LinearAttribution.fit(background, dict(zip(names, [t.coef for t in model.terms])), model.intercept,
                                    columns={t.feature: t.value for t in model.terms}, shown={t.feature: t.shown for t in model.terms},
                                    flags={t.feature: t.holds for t in model.terms if t.holds is not None})
