import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))


@pytest.fixture
def odd(spark):
    from fixtures import DOCS, odd_rows

    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture
def none(spark):
    from fixtures import DOCS

    return spark.createDataFrame([], DOCS)
