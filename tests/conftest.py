import os

os.environ.setdefault("PYSPARK_PYTHON", "python")
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import pytest

from barlab.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
           "spark.driver.memory": "6g", "spark.driver.host": "127.0.0.1"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
