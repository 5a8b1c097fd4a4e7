"""Raw loan table derived from the driver's star-schema tables.

One row per order (``FIXTURES.md`` §6). The derivation is a plain DataFrame
plan: ``lineitem`` is pre-aggregated per order (partial aggregation, then one
shuffle on ``l_orderkey``), left-joined to ``orders`` (co-partitioned on the
order key) and inner-joined to ``customer`` and ``nation``. Join strategies
are left to the planner: small dimensions are broadcast by Spark's own
size-checked threshold, large ones become sort-merge joins; AQE splits skewed
partitions. Money sums run over exact integer cents so every engine gets the same
bits.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STAR_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _cents_sum(c: str) -> Column:
    """Exact sum of a two-decimal money column: integer cents, back to units once."""
    return F.sum(F.round(F.col(c) * 100).cast("bigint")).cast("double") / 100.0


def order_line_stats(lineitem: DataFrame) -> DataFrame:
    """Per-order line statistics: count, returned lines, quantity, price, mean discount."""
    return (
        lineitem.groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("n_ret"),
            _cents_sum("l_quantity").alias("qty"),
            _cents_sum("l_extendedprice").alias("ext"),
            _cents_sum("l_discount").alias("disc_sum"),
        )
        .withColumn("disc", F.col("disc_sum") / F.col("n"))
        .drop("disc_sum")
    )


def _month_text(ts: Column) -> Column:
    return F.date_format(ts, "MMM-yyyy")


def raw_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw loan table (input of cleaning) over ``sf_dir``."""
    orders = read_table(spark, sf_dir, "orders")
    customer = read_table(spark, sf_dir, "customer")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    li = order_line_stats(read_table(spark, sf_dir, "lineitem"))

    base = (
        orders.join(customer, orders.o_custkey == customer.c_custkey, "inner")
        .join(nation, customer.c_nationkey == nation.n_nationkey, "inner")
        .join(li, orders.o_orderkey == li.l_orderkey, "left")
    )

    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    n_ret0 = F.coalesce(F.col("n_ret"), F.lit(0))
    n0 = F.coalesce(F.col("n"), F.lit(0))
    dbl = lambda c: c.cast("double")
    pending = F.col("o_orderstatus") == "P"
    is_joint = (ok % 10) == 0

    status = (
        F.when(pending & ((ok % 3) == 0), "Current")
        .when(pending & ((ok % 3) == 1), "Late (31-120 days)")
        .when((n_ret0 >= 3) | ((ok % 7) == 0),
              F.when((ok % 2) == 0, "Charged Off").otherwise("Default"))
        .otherwise("Fully Paid")
    )
    emp_k = ck % 13
    emp_length = (
        F.when(emp_k == 0, "< 1 year")
        .when(emp_k == 1, "1 year")
        .when(emp_k <= 9, F.concat(emp_k.cast("string"), F.lit(" years")))
        .when(emp_k == 10, "10+ years")
        .when(emp_k == 11, "n/a")
    )
    seg = F.col("c_mktsegment")
    home = (
        F.when(seg == "AUTOMOBILE", "OWN").when(seg == "BUILDING", "MORTGAGE")
        .when(seg == "FURNITURE", "RENT").when(seg == "HOUSEHOLD", "ANY")
    )
    issue_d = _month_text(F.col("o_orderdate"))
    ecl_months = F.lit(12) + (ck * 7) % 300
    earliest = _month_text(F.add_months(F.to_date("o_orderdate"), -ecl_months.cast("int")))

    return base.select(
        ok.cast("string").alias("id"),
        ck.cast("string").alias("member_id"),
        F.concat(F.lit("loan/"), ok.cast("string")).alias("url"),
        F.lit(1.0).alias("policy_code"),
        ok.alias("loan_id"),
        status.alias("loan_status"),
        F.round(F.col("o_totalprice").cast("decimal(18,2)") * F.lit(Decimal("0.08")), 2)
        .cast("double").alias("loan_amnt"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), " 60 months")
        .otherwise(" 36 months").alias("term"),
        emp_length.alias("emp_length"),
        F.col("c_name").alias("emp_title"),
        issue_d.alias("issue_d"),
        earliest.alias("earliest_cr_line"),
        issue_d.alias("last_credit_pull_d"),
        home.alias("home_ownership"),
        F.when(ck % 3 == 0, "Verified").when(ck % 3 == 1, "Source Verified")
        .otherwise("Not Verified").alias("verification_status"),
        F.when(is_joint, "Joint App").otherwise("Individual").alias("application_type"),
        F.when(ok % 2 == 0, "w").otherwise("f").alias("initial_list_status"),
        F.col("o_orderpriority").alias("purpose"),
        F.col("n_name").alias("addr_state"),
        F.when(F.col("c_acctbal") < 0, F.lit(None).cast("double"))
        .otherwise(F.col("c_acctbal") * 20).alias("annual_inc"),
        (F.col("qty") / 4.0).alias("dti"),
        (F.col("ext") / 20.0).alias("revol_bal"),
        (F.col("disc") * 1000).alias("revol_util"),
        dbl(n0 % 8).alias("inq_last_6mths"),
        dbl(n_ret0).alias("delinq_2yrs"),
        dbl(F.col("n") + 2).alias("open_acc"),
        dbl(F.col("n") + 2 + ck % 9).alias("total_acc"),
        (F.col("ext") / 10 + (ck % 7) * 1000).alias("total_rev_hi_lim"),
        (F.col("ext") / 4).alias("tot_cur_bal"),
        dbl(ok % 4).alias("pub_rec"),
        F.when(n_ret0 == 0, F.lit(None).cast("double")).otherwise(dbl(ok % 80))
        .alias("mths_since_last_delinq"),
        F.when(ok % 4 == 0, F.lit(None).cast("double")).otherwise(dbl(ck % 120))
        .alias("mths_since_last_record"),
        F.when(ok % 5 == 0, F.lit(None).cast("double")).otherwise(dbl(ok % 3)).alias("tax_liens"),
        dbl(F.col("n") % 5 + ck % 3).alias("inq_last_12m"),
        F.when(ok % 11 == 0, F.lit(None).cast("double")).otherwise(dbl(n_ret0 % 3))
        .alias("num_accts_ever_120_pd"),
        F.lit(None).cast("double").alias("il_util"),
        F.substring(F.lit("ABCDEFG"), (ck % 7).cast("int") + 1, 1).alias("grade"),
        (F.lit(5.0) + (ok % 200) / 10.0).alias("int_rate"),
        F.col("o_totalprice").alias("total_pymnt"),
        F.when(ok % 7 == 0, F.col("o_totalprice") / 100.0).otherwise(F.lit(0.0)).alias("recoveries"),
        F.when(is_joint, F.col("c_acctbal") * 30).otherwise(F.lit(None).cast("double"))
        .alias("annual_inc_joint"),
        F.when(is_joint, dbl(ck % 6)).otherwise(F.lit(None).cast("double")).alias("sec_app_open_acc"),
    )
