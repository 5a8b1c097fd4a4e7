import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from odd_rows import ROWS  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    p = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, name long").write.mode("overwrite").parquet(p)
    return spark.read.parquet(p)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("doc_id < 0")
