"""Sources and sinks.

Raw CSV is read with a declared schema in PERMISSIVE mode (bad cells become
null, no inference pass over 100 TB). Tables are written as Parquet,
partitioned by issue year so cohort filters prune files. Small results go to
CSV / JSON through ``coalesce(1)`` only when they are bounded (tier rows,
metric rows). Models are saved with MLlib writers plus a one-row metadata
table. Every path is a shared location (the cluster's checkpoint folder for
scratch), never a machine-local temp folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pdforge import constants as K
from pdforge.session import scratch_path

#: Column that holds the source line of a row with an unparsable cell.
CORRUPT = "_bad_line"

RAW_LOAN_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("member_id", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("policy_code", T.DoubleType()),
    T.StructField("loan_id", T.LongType()), T.StructField("loan_status", T.StringType()),
    T.StructField("loan_amnt", T.DoubleType()), T.StructField("term", T.StringType()),
    T.StructField("emp_length", T.StringType()), T.StructField("emp_title", T.StringType()),
    T.StructField("issue_d", T.StringType()), T.StructField("earliest_cr_line", T.StringType()),
    T.StructField("last_credit_pull_d", T.StringType()), T.StructField("home_ownership", T.StringType()),
    T.StructField("verification_status", T.StringType()), T.StructField("application_type", T.StringType()),
    T.StructField("initial_list_status", T.StringType()), T.StructField("purpose", T.StringType()),
    T.StructField("addr_state", T.StringType()),
    *[T.StructField(c, T.DoubleType()) for c in [
        "annual_inc", "dti", "revol_bal", "revol_util", "inq_last_6mths", "delinq_2yrs", "open_acc", "total_acc",
        "total_rev_hi_lim", "tot_cur_bal", "pub_rec", "mths_since_last_delinq", "mths_since_last_record",
        "tax_liens", "inq_last_12m", "num_accts_ever_120_pd", "il_util"]],
    T.StructField("grade", T.StringType()), T.StructField("int_rate", T.DoubleType()),
    T.StructField("total_pymnt", T.DoubleType()), T.StructField("recoveries", T.DoubleType()),
    T.StructField("annual_inc_joint", T.DoubleType()), T.StructField("sec_app_open_acc", T.DoubleType()),
])


def write_scratch(df: DataFrame, fmt: str, name: str, **options) -> str:
    """Write ``df`` under the shared checkpoint folder and return the path."""
    path = scratch_path(df.sparkSession, name)
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w = (w.option("header", True).option("ignoreLeadingWhiteSpace", False)
             .option("ignoreTrailingWhiteSpace", False))
    for k, v in options.items():
        w = w.option(k, v)
    w.format(fmt).save(path)
    return path


def loan_schema() -> T.StructType:
    """Types of every raw column the cleaning names: the declared ones, and double for all it fills or caps."""
    numeric = dict.fromkeys(K.NEVER_HAPPENED_COLUMNS + K.ZERO_FILL_COLUMNS + K.MEDIAN_FILL_COLUMNS + K.CAP_COLUMNS)
    declared = set(RAW_LOAN_SCHEMA.names)
    return T.StructType(RAW_LOAN_SCHEMA.fields + [T.StructField(c, T.DoubleType()) for c in numeric if c not in declared])


def _csv_header(spark: SparkSession, path: str, required) -> list[str]:
    """The header's names; one error names every repeated and every missing column."""
    rows = (spark.read.option("header", False).option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False).csv(path).limit(1).collect())  # the first line alone
    names = list(rows[0]) if rows else []
    twice = sorted({str(c) for c in names if names.count(c) > 1 or c in (None, "", CORRUPT)})
    missing = [c for c in required if c not in names]
    if twice or missing:
        raise ValueError("; ".join([f"{path}: " + t for t in (
            twice and f"repeated, empty or reserved columns {twice}", missing and f"missing columns {missing}") if t]))
    return names


def _csv_reader(spark: SparkSession, schema: T.StructType):
    # enforceSchema off: every file's header is compared with the schema, so a part file whose
    # columns stand in another order is an error instead of values under wrong names
    return (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False)
            .option("columnNameOfCorruptRecord", CORRUPT)
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))


def read_loans_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, required=(),
                   keep_bad: bool = False) -> DataFrame:
    """CSV with declared types, columns found by the header's names.

    Columns may stand in any order; undeclared ones are text. Unparsable cells become
    null; ``keep_bad`` adds the source line of rows with one among the columns that are
    read (``_bad_line``, else null). A missing ``required`` column, a repeated name or a
    file with another header is an error.
    """
    fields = {f.name: f for f in (schema or loan_schema()).fields}
    names = _csv_header(spark, path, required)
    typed = [fields.get(c, T.StructField(c, T.StringType())) for c in names]
    if keep_bad:
        typed.append(T.StructField(CORRUPT, T.StringType()))
    return _csv_reader(spark, T.StructType(typed)).csv(path)


def csv_bad_cells(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """S1's data check: (column, bad_cells) of every typed column, non-empty text that is not of its type.

    One aggregate over the text of the file; columns without a bad cell are reported with 0.
    """
    fields = {f.name: f for f in (schema or loan_schema()).fields}
    names = _csv_header(spark, path, ())
    text = _csv_reader(spark, T.StructType([T.StructField(c, T.StringType()) for c in names])).csv(path)
    typed = [c for c in names if c in fields and not isinstance(fields[c].dataType, T.StringType)]
    if not typed:
        return spark.createDataFrame([], "column string, bad_cells long")
    bad = text.agg(*[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(fields[c].dataType).isNull()).alias(f"n{i}")
                     for i, c in enumerate(typed)])
    return bad.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("bad_cells"))
                                         for i, c in enumerate(typed)])))


def csv_to_parquet(spark: SparkSession, csv_path: str, out_path: str) -> dict:
    """S1 + S3 + S4: CSV -> Parquet, then verify by re-reading (rows, columns, bytes)."""
    df = read_loans_csv(spark, csv_path)
    df.write.mode("overwrite").parquet(out_path)
    return verify_export(spark, out_path)


def verify_export(spark: SparkSession, path: str) -> dict:
    """Rows and columns from the written files; size from file metadata."""
    back = spark.read.parquet(path)
    stats = back.agg(F.count(F.lit(1)).alias("rows")).first()
    size = (back.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s"))
            .distinct().agg(F.sum("s")).first()[0] or 0)
    return {"rows": stats["rows"], "columns": len(back.columns), "bytes": size,
            "file_size_mb": round(size / 1024 ** 2, 1), "output": path}


def scan_schema(spark: SparkSession, path: str) -> T.StructType:
    """Schema of a Parquet table without reading rows."""
    return spark.read.parquet(path).schema


def write_table(df: DataFrame, path: str, partition_by: str | None = "issue_year", mode: str = "overwrite"):
    """Parquet table, partitioned by cohort year when present.

    ``mode='ignore'`` materialises only when the target is absent (S14).
    """
    w = df.write.mode(mode)
    if partition_by and partition_by in df.columns:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    return path


def write_small_csv(df: DataFrame, path: str):
    """A bounded result (tier rows, importance rows) as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def read_small_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """S9."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_json(df: DataFrame, path: str):
    """Model comparison (nested rows) as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)
    return path


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """S11."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)
