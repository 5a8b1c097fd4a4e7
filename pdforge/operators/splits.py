"""Splits and samples: out-of-time split (F4), cohort filter (F5), union of
train and validation (W7), seeded fixed-size sample (W8), exact stratified
sample (W9) and stratified folds (W10).

Samples are deterministic functions of the data (hash of the key with a
seed), not of partitioning, so re-running a task after executor loss gives
the same rows. Quotas and folds of a class are thresholds of the seeded order,
found exactly from the (class, hash) pairs alone and applied to the wide rows
as literals: a narrow filter or projection, no shuffle, no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pdforge import constants as K
from pdforge.operators.stats import sketch_columns, values_at_ranks


def split_label(year="issue_year", train_max: int = K.TRAIN_MAX_YEAR, val_year: int = K.VAL_YEAR,
                test_year: int = K.TEST_YEAR) -> Column:
    """'train' (<= train_max), 'val', 'test'; other or null years -> null."""
    y = F.col(year)
    return (F.when(y <= train_max, "train").when(y == val_year, "val")
            .when(y == test_year, "test"))


def split_predicate(name: str, year="issue_year", train_max: int = K.TRAIN_MAX_YEAR, val_year: int = K.VAL_YEAR,
                    test_year: int = K.TEST_YEAR) -> Column:
    """The row filter of one split written on the year itself, so it is pushed to the scan
    (and prunes partitions of a table partitioned by year); a filter on the derived label is not."""
    y = F.col(year)
    return {"train": y <= train_max, "val": y == val_year, "test": y == test_year}[name]


def with_split(df: DataFrame, **kw) -> DataFrame:
    return df.where(F.col("target").isNotNull()).withColumn("split", split_label(**kw))


def cohort(df: DataFrame, year: int = K.TEST_YEAR) -> DataFrame:
    """one issue year (partition pruning when the table is partitioned by year)."""
    return df.where(F.col("issue_year") == year)


def hash_order(key: str = "loan_id", seed: int = K.RANDOM_SEED) -> Column:
    """Uniform-looking, seeded, data-determined order in [0, 1)."""
    h = F.xxhash64(F.col(key), F.lit(seed))
    return F.pmod(h, F.lit(1 << 52)).cast("double") / float(1 << 52)


def deterministic_sample(df: DataFrame, n: int, key: str = "loan_id",
                         seed: int = K.RANDOM_SEED) -> DataFrame:
    """The n rows with the smallest seeded hash (exact, without replacement).

    A bare ``orderBy.limit(n)`` merges n rows from every task in one task,
    which grows with the partition count. The hash is uniform on [0, 1), so the
    n-th smallest value is close to n / N: rows above a threshold a few
    standard deviations past that are dropped first (the threshold doubles
    while fewer than n rows pass, which keeps the result exact), and only
    about n candidates reach the final ordered take.
    """
    import math

    t = df.withColumn("_u", hash_order(key, seed))
    total = t.count()
    if total <= n:
        return t.drop("_u")
    cut = min(1.0, (n + 6.0 * math.sqrt(n) + 16.0) / total)
    while cut < 1.0 and t.where(F.col("_u") <= cut).count() < n:
        cut = min(1.0, cut * 2.0)
    return t.where(F.col("_u") <= cut).orderBy("_u", key).limit(n).drop("_u")


def class_cuts(df: DataFrame, sizes: dict, ranks: dict, label: str, order: Column, **kw) -> dict:
    """{class: {rank: order value}}: exact order statistics of the seeded order inside each class.

    One narrow column per class (labels have few values) goes through
    ``stats.values_at_ranks``; no row passes a window.
    """
    classes = list(sizes)
    narrow = df.select(F.col(label).alias("_label"), order.alias("_u")).select(
        *[F.when(F.col("_label").eqNullSafe(F.lit(k)), F.col("_u")).alias(f"c{i}") for i, k in enumerate(classes)])
    wanted = {f"c{i}": set(ranks.get(k, ())) for i, k in enumerate(classes)}
    wanted = {c: r for c, r in wanted.items() if r}
    if not wanted:
        return {k: {} for k in classes}
    sketches = sketch_columns(narrow, list(wanted), **{k: v for k, v in kw.items() if k != "finish_rows"})
    found = values_at_ranks(narrow, wanted, sketches, **kw)
    return {k: {r: found[(f"c{i}", r)] for r in wanted.get(f"c{i}", ())} for i, k in enumerate(classes)}


def class_sizes(df: DataFrame, label: str) -> dict:
    return {r[label]: r["count"] for r in df.groupBy(label).count().collect()}  # one row per class


def stratified_quotas(counts: dict, n: int) -> dict:
    """Largest-remainder allocation of n rows over classes in proportion to size."""
    total = sum(counts.values())
    if n >= total:
        return dict(counts)
    raw = {k: n * v / total for k, v in counts.items()}
    q = {k: int(r) for k, r in raw.items()}
    rest = n - sum(q.values())
    for k in sorted(raw, key=lambda k: (-(raw[k] - q[k]), k is None, k if k is not None else 0))[:rest]:
        q[k] += 1
    return q


def stratified_sample(df: DataFrame, n: int, label: str = "target", key: str = "loan_id",
                      seed: int = K.RANDOM_SEED, **kw) -> DataFrame:
    """Exactly n rows (or all rows when fewer), class mix kept.

    Each class keeps the rows below the hash at its quota. Only where several
    rows of a class share that very hash (repeated or null keys) are they ordered,
    by key and content, and as many taken as the quota lacks.
    """
    sizes = class_sizes(df, label)
    quotas = {k: q for k, q in stratified_quotas(sizes, n).items() if q > 0}
    order = hash_order(key, seed)
    cuts = class_cuts(df, sizes, {k: {q - 1} for k, q in quotas.items()}, label, order, **kw)
    if not quotas:
        return df.limit(0)
    cut = F.lit(None).cast("double")
    for k, q in quotas.items():  # one branch per class; a null label is a class
        cut = F.when(F.col(label).eqNullSafe(F.lit(k)), F.lit(cuts[k][q - 1])).otherwise(cut)
    held = {r["_label"]: (r["below"], r["at"]) for r in
            df.select(F.col(label).alias("_label"), order.alias("_u"), cut.alias("_cut")).groupBy("_label")
            .agg(F.count_if(F.col("_u") < F.col("_cut")).alias("below"),
                 F.count_if(F.col("_u") == F.col("_cut")).alias("at")).collect()}  # one row per class
    tied = [k for k, q in quotas.items() if sum(held[k]) != q]
    if not tied:
        return df.where(order <= cut)
    exact = F.lit(False)
    for k in tied:
        exact = exact | F.col(label).eqNullSafe(F.lit(k))
    out = df.where((order < cut) | ((order == cut) & ~exact))
    content = F.xxhash64(*[F.col(c) for c in df.columns])
    for k in tied:
        rows = df.where(F.col(label).eqNullSafe(F.lit(k)) & (order == cut))
        out = out.unionByName(rows.orderBy(F.col(key), content).limit(quotas[k] - held[k][0]))
    return out


def stratified_folds(df: DataFrame, k: int = 5, label: str = "target", key: str = "loan_id",
                     seed: int = K.RANDOM_SEED, **kw) -> DataFrame:
    """K folds of each class, cut at equal ranks of its seeded hash order (sizes differ by one at most).

    Rows with one key share a hash and so a fold: a repeated loan is never on both sides of a split.
    """
    sizes = class_sizes(df, label)
    starts = {c: [sum((m - f + k - 1) // k for f in range(i)) for i in range(1, k)] for c, m in sizes.items()}
    order = hash_order(key, seed)
    cuts = class_cuts(df, sizes, {c: {r for r in starts[c] if r < sizes[c]} for c in sizes}, label, order, **kw)
    fold = F.lit(0)
    for c in sizes:
        mine = F.lit(0)
        for r in starts[c]:
            if r < sizes[c]:
                mine = mine + (order >= F.lit(cuts[c][r])).cast("int")
        fold = F.when(F.col(label).eqNullSafe(F.lit(c)), mine).otherwise(fold)
    return df.withColumn("fold", fold.cast("int"))
