"""Distributed order statistics: prefix sums and exact quantiles.

Spark's exact ``percentile``/``median`` merges one value->count map per group
in a single task, which does not bound memory when a column has billions of
distinct values. These operators stay exact and distributed instead:

* ``prefix_sums`` — two-level running sum over an ordered key: rows are cut
  into range buckets (split points from ``percentile_approx``; their number is
  a parameter, so the collected splits are bounded), bucket totals are summed
  over at most ``groups x buckets`` rows, and a window inside each bucket adds
  the local running sum. No single-partition window over the data.
* ``values_at_ranks`` — exact order statistics of any number of columns without
  an unpivot: mergeable sketches of all columns in one aggregate propose an
  interval for each rank, a second aggregate counts below and up to its ends,
  and only the few values strictly inside are shuffled.
* ``quantile_values`` — exact continuous quantiles (linear interpolation
  between the ranks floor/ceil of (n-1)p) from those order statistics.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_BUCKET = 2_000_000
MAX_BUCKETS = 8192
#: Small inputs are cut as well, so every size takes the same path.
MIN_BUCKETS = 8
#: Shares a sketch reports; an interval between two neighbours holds about 1 / GRID of the values.
GRID = 400
#: Rank error of a sketch: at most 1 / ACCURACY of the values.
ACCURACY = 10_000
#: Values of one interval that are counted one by one, in one window partition.
FINISH_ROWS = 1_000_000


def _group_key(group_cols: list[str]):
    if not group_cols:
        return F.lit("")
    return F.concat_ws("\u0001", *[F.col(g).cast("string") for g in group_cols])


def _bucket_udf(splits: dict[str, np.ndarray]):
    @F.pandas_udf(T.IntegerType())
    def bucket(g: pd.Series, k: pd.Series) -> pd.Series:
        out = np.zeros(len(k), dtype=np.int32)
        gv = g.to_numpy()
        kv = k.to_numpy(dtype=float)
        for key in pd.unique(gv):
            sel = gv == key
            s = splits.get(key)
            if s is not None and len(s):
                out[sel] = np.searchsorted(s, kv[sel], side="right")
        return pd.Series(out)

    return bucket


def prefix_sums(df: DataFrame, group_cols: list[str], order_col: str, sum_cols: list[str],
                descending: bool = False, rows_per_bucket: int = ROWS_PER_BUCKET,
                max_buckets: int = MAX_BUCKETS, n_max: int | None = None) -> DataFrame:
    """Add ``<c>_before`` = sum of ``c`` over rows strictly before in the order, per group.

    ``df`` must have one row per (group, order value) — aggregate first.
    """
    key = F.col(order_col).cast("double")
    t = df.withColumn("_k", -key if descending else key)

    if n_max is None:  # rows of the largest group decide the number of buckets
        n_max = (t.groupBy(*group_cols).count().agg(F.max("count")).first()[0] or 0) if group_cols \
            else t.count()
    n_buckets = int(min(max_buckets, max(MIN_BUCKETS, math.ceil(n_max / max(1, rows_per_bucket)))))

    probs = [i / n_buckets for i in range(1, n_buckets)]
    acc = max(10_000, 20 * n_buckets)
    split_rows = (t.groupBy(*group_cols)
                  .agg(F.percentile_approx("_k", probs, acc).alias("_s"))
                  .select(_group_key(group_cols).alias("_g"), "_s").collect())  # groups x buckets values: bounded by max_buckets
    splits = {r["_g"]: np.unique(np.asarray(r["_s"], dtype=float)) for r in split_rows if r["_s"] is not None}
    t = t.withColumn("_b", _bucket_udf(splits)(_group_key(group_cols), F.col("_k")))

    tot = t.groupBy(*group_cols, "_b").agg(*[F.sum(c).alias(c) for c in sum_cols])
    wb = (Window.partitionBy(*group_cols) if group_cols else Window).orderBy("_b") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = tot.select(*group_cols, "_b",
                         *[F.coalesce(F.sum(c).over(wb), F.lit(0)).alias(f"_{c}_off") for c in sum_cols])
    # offsets has at most (groups x buckets) rows: bounded by parameters, safe to broadcast
    off = offsets.select(*[F.col(c).alias(f"_g_{c}") for c in group_cols], F.col("_b").alias("_ob"),
                         *[f"_{c}_off" for c in sum_cols])
    on = t["_b"] == off["_ob"]
    for c in group_cols:  # a null group is a group
        on = on & t[c].eqNullSafe(off[f"_g_{c}"])
    t = t.join(F.broadcast(off), on)
    w = Window.partitionBy(*group_cols, "_b").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    t = t.select(*df.columns,
                 *[(F.col(f"_{c}_off") + F.coalesce(F.sum(c).over(w), F.lit(0))).alias(f"{c}_before")
                   for c in sum_cols])
    return t


@dataclass
class Sketch:
    """What the first pass learns of a column: rows, non-null values, values at evenly spaced shares."""
    rows: int
    n: int
    grid: list


def sketch_columns(df: DataFrame, columns: list[str], grid: int = GRID, accuracy: int = ACCURACY,
                   spans: dict | None = None) -> dict[str, Sketch]:
    """One aggregate over all columns: counts, and ``grid + 1`` approximate quantiles each.

    ``spans`` ({name: (column, low, high)}) sketches only the values strictly inside an interval.
    """
    spans = spans or {c: (c, None, None) for c in columns}
    shares = F.array(*[F.lit(i / grid) for i in range(grid + 1)])
    exprs = [F.count(F.lit(1))]
    for c, low, high in spans.values():
        v = _inside(F.col(c).cast("double"), low, high)
        exprs += [F.count(v), F.percentile_approx(v, shares, accuracy)]
    row = df.agg(*[e.alias(f"_{i}") for i, e in enumerate(exprs)]).first()  # one row: spans x grid values
    return {name: Sketch(row[0], row[1 + 2 * i], list(row[2 + 2 * i] or [])) for i, name in enumerate(spans)}


def _inside(v, low, high):
    """``v`` where it lies strictly between the bounds (None: open), else null."""
    if low is not None:
        v = F.when(v > F.lit(low), v)
    return v if high is None else F.when(v < F.lit(high), v)


def _place(cuts: list[tuple], n: int, rank: int) -> tuple:
    """Where a rank falls among counted cuts ``(value, below, upto)``: ``(value,)`` or the
    open interval ``(None, low, high, base, size)`` around it."""
    low, base, high, end = None, 0, None, n
    for v, below, upto in cuts:
        if below <= rank < upto:
            return (v,)
        if upto <= rank and (low is None or upto > base):
            low, base = v, upto
        if below > rank and (high is None or below < end):
            high, end = v, below
    return (None, low, high, base, end - base)


def values_at_ranks(df: DataFrame, ranks: dict[str, set], sketches: dict[str, Sketch],
                    finish_rows: int = FINISH_ROWS, grid: int = GRID, accuracy: int = ACCURACY) -> dict:
    """Exact order statistics: {(column, rank): value}, ranks from 0 among a column's non-null values.

    The sketch names two values that should enclose a rank; one aggregate counts the values below
    and up to each of them, so where the rank really lies is known, not estimated. A rank that falls
    on a counted value is answered (a value that holds a third of all rows always is). Otherwise the
    open interval around it is sketched again until it holds at most ``finish_rows`` values; only
    those are counted one by one. Columns are read once more per round and never unpivoted whole.
    """
    columns = [c for c in ranks if ranks[c]]
    out = {}
    if not columns:
        return out
    t = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    cuts = {c: [] for c in columns}
    todo = {(c, r): (None, None, None, 0, sketches[c].n) for c in columns for r in ranks[c]}
    sketch = {(c, None, None): sketches[c] for c in columns}
    while sketch:
        asked = {c: set() for c in columns}
        for (c, r), (_, low, high, base, size) in todo.items():
            s = sketch.get((c, low, high))
            if s is None or not s.grid:
                continue
            share, slack = (r - base + 0.5) / size, 2.0 / accuracy
            for i in (math.floor((share - slack) * grid), math.ceil((share + slack) * grid)):
                if 0 <= i <= grid:
                    asked[c].add(float(s.grid[i]))
        pairs = [(c, v) for c in columns for v in sorted(asked[c])]
        if pairs:
            exprs = [e for c, v in pairs for e in (F.count_if(F.col(c) < F.lit(v)), F.count_if(F.col(c) <= F.lit(v)))]
            row = t.agg(*[e.alias(f"_{i}") for i, e in enumerate(exprs)]).first()  # one row of counts
            for i, (c, v) in enumerate(pairs):
                cuts[c].append((v, row[2 * i], row[2 * i + 1]))
        before, todo = todo, {}
        for (c, r), old in before.items():
            at = _place(cuts[c], sketches[c].n, r)
            if len(at) == 1:
                out[(c, r)] = at[0]
            else:
                todo[(c, r)] = at
        again = {(c, at[1], at[2]) for (c, r), at in todo.items()
                 if at[4] > finish_rows and at[4] < before[(c, r)][4]}  # an interval that stops shrinking is finished below
        names = {f"s{i}": key for i, key in enumerate(sorted(again, key=str))}
        found = sketch_columns(t, [], grid, accuracy, names) if names else {}
        sketch = {names[k]: s for k, s in found.items()}
    if not todo:
        return out
    spans = sorted({(c, at[1], at[2], at[3]) for (c, _), at in todo.items()}, key=str)
    number = {(c, low, high): i for i, (c, low, high, _) in enumerate(spans)}
    entries = []
    for i, (c, low, high, _) in enumerate(spans):
        v = _inside(F.col(c), low, high)
        entries.append(F.when(v.isNotNull(), F.struct(F.lit(i).alias("span"), v.alias("v"))))
    counts = t.select(F.inline(F.array_compact(F.array(*entries)))).groupBy("span", "v").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("span").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)  # finish_rows values at most
    running = counts.withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0)))
    wanted = t.sparkSession.createDataFrame(
        [(number[(c, at[1], at[2])], c, r, r - at[3]) for (c, r), at in todo.items()],
        "span int, column string, rank long, place long")
    hits = (running.join(F.broadcast(wanted), "span")  # one row per asked rank
            .where((F.col("before") <= F.col("place")) & (F.col("place") < F.col("before") + F.col("c")))
            .select("column", "rank", "v").collect())
    out.update({(h["column"], h["rank"]): h["v"] for h in hits})
    return out


def interpolation_ranks(n: int, p: float) -> tuple[float, int, int]:
    """The continuous position ``(n - 1) p`` and the ranks on both sides of it."""
    h = (n - 1) * float(p)
    return h, math.floor(h), math.ceil(h)


def quantile_values(df: DataFrame, columns: list[str], probs: list[float], **kw) -> dict:
    """Exact continuous quantiles (linear interpolation) as {(column, p): value}; null for all-null columns."""
    if not columns:
        return {}
    sketches = sketch_columns(df, columns, **{k: v for k, v in kw.items() if k != "finish_rows"})
    at = {(c, float(p)): interpolation_ranks(sketches[c].n, p)
          for c in columns if sketches[c].n for p in probs}
    ranks = {c: set() for c in columns}
    for (c, _), (_, lo, hi) in at.items():
        ranks[c] |= {lo, hi}
    found = values_at_ranks(df, ranks, sketches, **kw)
    out = {(c, float(p)): None for c in columns for p in probs}
    for (c, p), (h, lo, hi) in at.items():
        low, high = found[(c, lo)], found[(c, hi)]
        out[(c, p)] = low + (h - lo) * (high - low)
    return out


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float], **kw) -> DataFrame:
    """(column, p, value) frame of exact continuous quantiles (null for all-null columns)."""
    rows = [(c, p, v) for (c, p), v in sorted(quantile_values(df, columns, probs, **kw).items())]
    return df.sparkSession.createDataFrame(rows, "column string, p double, value double")


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: number of nulls per column (single pass, partial aggregation)."""
    cols = columns or df.columns
    return df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols])
