import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_rows import CLASH, ODD, SCHEMA, SF, documents  # noqa: E402


@pytest.fixture
def odd(spark):
    return documents(spark, ODD, extra=CLASH)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
