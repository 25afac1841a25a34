import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lorespark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", "tests", 4, {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def value(spark):
    """Evaluate one column over one row of named values."""

    def evaluate(function, **columns):
        frame = spark.createDataFrame([tuple(columns.values())], list(columns)) if columns else spark.range(1)
        return frame.select(function.alias("result")).first()["result"]

    return evaluate
