"""The raw CSV contract: columns by name, bad cells, headers that do not fit."""

import pytest
from pyspark.sql import functions as F

from pdforge.operators import cleaning as CL
from pdforge.plans.cleaning_job import run_cleaning
from pdforge.session import scratch_path
from pdforge.sources import io


def _write(spark, lines):
    path = scratch_path(spark, "csv_lines")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


def test_columns_are_found_by_name_and_bad_cells_are_reported(spark):
    path = _write(spark, ["note,dti,loan_id,mort_acc", 'x,12.5,1,2', '"a, b",n/a,2,', ",,x3,oops"])
    rows = io.read_loans_csv(spark, path, required=["loan_id", "dti"], keep_bad=True).collect()
    got = sorted(((r.note, r.dti, r.loan_id, r.mort_acc, r[io.CORRUPT] is None) for r in rows), key=str)
    assert got == sorted([("x", 12.5, 1, 2.0, True), ("a, b", None, 2, None, False), (None, None, None, None, False)], key=str)
    bad = {r.column: r.bad_cells for r in io.csv_bad_cells(spark, path).collect()}
    assert bad == {"dti": 1, "loan_id": 1, "mort_acc": 1}
    assert io.read_loans_csv(spark, path).columns == ["note", "dti", "loan_id", "mort_acc"]


def test_all_missing_and_repeated_columns_are_named_at_once(spark):
    path = _write(spark, ["dti,dti,loan_id", "1,2,3"])
    with pytest.raises(ValueError) as e:
        io.read_loans_csv(spark, path, required=["loan_id", "loan_status", "term"])
    assert "['dti']" in str(e.value) and "['loan_status', 'term']" in str(e.value)


def test_a_file_with_another_column_order_is_refused(spark):
    path = _write(spark, ["dti,loan_id", "1.5,2"])
    spark.createDataFrame([("loan_id,dti",), ("4,2.5",)], "value string").coalesce(1).write.mode("append").text(path)
    with pytest.raises(Exception, match="(?i)header"):
        io.read_loans_csv(spark, path).collect()


def test_strict_cleaning_names_every_missing_column(spark):
    raw = spark.range(3).select(F.col("id").alias("loan_id"), F.lit("Fully Paid").alias("loan_status"))
    with pytest.raises(ValueError) as e:
        run_cleaning(raw, strict=True)
    assert all(f"'{c}'" in str(e.value) for c in CL.REQUIRED_COLUMNS if c != "loan_status")
