"""Portfolio aggregates: tier validation (A8), portfolio summary with shares
(A9/A10), totals (A11), cohort statistics (A6/A7), split sizes (A12), class
ratio (A13), PD histogram (A16) and tier monotonicity (M10).

Each is one ``groupBy`` with partial aggregation (map-side combine), so a
tier holding most loans costs one pre-aggregated row per task in the shuffle.
Money sums run over exact decimals of each value, so results do not depend on
row order. Share windows run over the <= 5 tier rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pdforge import constants as K
from pdforge.functions import risk as R


def dec_sum(c, scale: int = 4) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c.cast("double").cast(f"decimal(28,{scale})"))


def with_loss_columns(scored: DataFrame, lgd: float = K.DEFAULT_LGD) -> DataFrame:
    """EAD = amount or 0; EL = rounded PD x LGD x EAD."""
    ead = R.exposure_at_default("loan_amnt")
    return scored.withColumns({"ead": ead,
                               "expected_loss": R.expected_loss(F.col("probability_of_default"), ead, lgd)})


def portfolio_summary(scored: DataFrame, lgd: float = K.DEFAULT_LGD) -> DataFrame:
    """A9 + A10 (B6 after scoring): one row per tier, with shares of loans and exposure."""
    p = with_loss_columns(scored, lgd)
    by_tier = p.groupBy("risk_tier").agg(
        F.count("loan_amnt").alias("loan_count"),
        dec_sum("ead").alias("_exposure"),
        dec_sum("probability_of_default").alias("_pd_sum"),
        F.count("probability_of_default").alias("_pd_n"),
        F.sum(F.col("target").cast("long")).alias("_defaults"),
        F.count("target").alias("_target_n"),
        dec_sum("expected_loss", 6).alias("_el"),
        F.count_if(F.col("policy_decision") == "Approve").alias("approve_count"),
        F.count_if(F.col("policy_decision") == "Refer").alias("refer_count"),
        F.count_if(F.col("policy_decision") == "Deny").alias("deny_count"),
    )
    everything = Window.partitionBy()  # over the <= 5 tier rows
    return by_tier.select(
        "risk_tier", "loan_count",
        F.round("_exposure", 2).cast("double").alias("total_exposure"),
        (F.col("_pd_sum").cast("double") / F.col("_pd_n")).alias("avg_pd"),
        (F.col("_defaults").cast("double") / F.col("_target_n")).alias("actual_default_rate"),
        F.round("_el", 4).cast("double").alias("total_expected_loss"),
        "approve_count", "refer_count", "deny_count",
        F.round(F.col("loan_count") / F.sum("loan_count").over(everything) * 100, 1).alias("pct_of_portfolio"),
        F.round(F.col("_exposure").cast("double") / F.sum("_exposure").over(everything).cast("double") * 100, 1)
        .alias("pct_of_exposure"),
    )


def portfolio_totals(scored: DataFrame, lgd: float = K.DEFAULT_LGD) -> DataFrame:
    """Total exposure, total expected loss, EL rate (%)."""
    p = with_loss_columns(scored, lgd)
    t = p.agg(dec_sum("ead").alias("_exp"), dec_sum("expected_loss", 6).alias("_el"),
              F.count(F.lit(1)).alias("loans"))
    return t.select(
        "loans",
        F.round("_exp", 2).cast("double").alias("total_exposure"),
        F.round("_el", 4).cast("double").alias("total_expected_loss"),
        F.round(F.col("_el").cast("double") / F.col("_exp").cast("double") * 100, 4).alias("el_rate_pct"),
    )


def tier_validation(scored: DataFrame) -> DataFrame:
    """A8 + W2: count, mean PD, actual default rate per tier, in tier order."""
    t = scored.groupBy("risk_tier").agg(
        F.count("probability_of_default").alias("count"),
        dec_sum("probability_of_default").alias("_pd"),
        F.sum(F.col("target").cast("long")).alias("_d"),
        F.count("target").alias("_n"))
    return (t.select("risk_tier", R.tier_rank("risk_tier").alias("tier_rank"), "count",
                     (F.col("_pd").cast("double") / F.col("count")).alias("avg_pd"),
                     (F.col("_d").cast("double") / F.col("_n")).alias("actual_default_rate"))
            .orderBy("tier_rank"))


def tier_monotonicity(scored: DataFrame) -> DataFrame:
    """Per tier, the previous tier's actual rate and whether the rate rises."""
    v = tier_validation(scored)
    w = Window.orderBy("tier_rank")  # 5 rows
    prev = F.lag("actual_default_rate").over(w)
    return v.select("risk_tier", "tier_rank", "actual_default_rate",
                    prev.alias("prev_default_rate"),
                    F.when(prev.isNull(), F.lit(True))
                    .otherwise(F.col("actual_default_rate") >= prev).alias("is_monotone_step"))


def default_rate_by_year(features: DataFrame) -> DataFrame:
    """A6 + W3: loans and default rate per issue year, sorted."""
    return (features.groupBy("issue_year")
            .agg(F.count(F.lit(1)).alias("loans"),
                 (F.sum(F.col("target").cast("long")).cast("double") / F.count("target")).alias("default_rate"))
            .orderBy("issue_year"))


def distinct_years(features: DataFrame) -> DataFrame:
    """A7."""
    return features.select("issue_year").distinct().orderBy("issue_year")


def split_sizes(with_split: DataFrame) -> DataFrame:
    """Rows and default rate per split."""
    return (with_split.where(F.col("split").isNotNull()).groupBy("split")
            .agg(F.count(F.lit(1)).alias("rows"),
                 (F.sum(F.col("target").cast("long")).cast("double") / F.count("target")).alias("default_rate")))


def class_ratio(df: DataFrame, label: str = "target") -> DataFrame:
    """Negatives / positives (the boosted-tree positive weight)."""
    y = F.col(label).cast("long")
    return df.agg(F.sum(1 - y).alias("negatives"), F.sum(y).alias("positives")) \
        .withColumn("neg_pos_ratio", F.col("negatives").cast("double") / F.col("positives"))


def pd_histogram(scored: DataFrame, bins: int = 40, col: str = "probability_of_default") -> DataFrame:
    """Equal-width bins over [min, max], last bin closed; empty bins kept.

    min / max are two scalars read back from one global aggregate (J5).
    """
    lo, hi = scored.agg(F.min(col), F.max(col)).first()
    spark = scored.sparkSession
    all_bins = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    if lo is None:
        return all_bins.select("bin", F.lit(None).cast("double").alias("bin_start"),
                               F.lit(0).cast("bigint").alias("count"))
    if lo == hi:  # a single value: one unit-wide range centred on it
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    b = F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = scored.where(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    edges = all_bins.select("bin", (F.lit(lo) + F.col("bin") * F.lit(hi - lo) / bins).alias("bin_start"))
    return edges.join(F.broadcast(counts), "bin", "left").select(
        "bin", "bin_start", F.coalesce("count", F.lit(0)).alias("count")).orderBy("bin")
