import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pagewright.functions.sql import Expr  # noqa: E402
from pagewright.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", 8, **{"spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Evaluate an expression over a list of values of one column ``x``."""

    def run(values, expression, kind="string"):
        rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
        out = rows.select("i", expression.alias("y").col if isinstance(expression, Expr) else expression.alias("y"))
        return [r.y for r in out.orderBy("i").collect()]

    return run
