import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from tabloom.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.maxMetadataStringLength": "2000",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
