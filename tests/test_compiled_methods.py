"""Wide projections stay within methods that the JVM compiles."""

import pytest

from paths import SF001
from pdforge.session import compiled_methods

LIMIT = "spark.sql.codegen.hugeMethodLimit"


def test_wide_preparation_runs_in_compiled_methods(spark, monkeypatch):
    from pdforge.plans import cleaning_job as CJ
    from pdforge.plans.catalog import raw
    seen, before, write = [], spark.conf.get(LIMIT), CJ.materialize
    monkeypatch.setattr(CJ, "materialize", lambda df, name: seen.append(int(spark.conf.get(LIMIT))) or write(df, name))
    CJ.run_cleaning(raw(spark, SF001), columns=["loan_id", "target", "dti"])
    assert seen and max(seen) <= 8000 and spark.conf.get(LIMIT) == before


def test_compiled_methods_keep_a_lower_limit_and_restore_after_errors(spark):
    before = spark.conf.get(LIMIT)
    with pytest.raises(RuntimeError), compiled_methods(spark):
        raise RuntimeError
    assert spark.conf.get(LIMIT) == before
    spark.conf.set(LIMIT, "500")
    try:
        with compiled_methods(spark):
            assert spark.conf.get(LIMIT) == "500"
        assert spark.conf.get(LIMIT) == "500"
    finally:
        spark.conf.set(LIMIT, before)
