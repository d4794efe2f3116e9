import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[8]").appName("tests")
               .config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
               .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
               .config("spark.ui.showConsoleProgress", "false").config("spark.log.level", "ERROR").getOrCreate())
    from mapframe import prepare

    prepare(session)
    yield session
    session.stop()


def pytest_collection_modifyitems(items):
    items.sort(key=lambda item: "workload" in item.nodeid)
