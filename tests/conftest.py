import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from isohyet.session import tune

    session = (
        SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return tune(session)


@pytest.fixture(scope="session")
def folder():
    return SMALL


@pytest.fixture(scope="session")
def panel(spark, folder):
    from isohyet.sources.derived import stored_panel

    return stored_panel(spark, folder)


@pytest.fixture(scope="session")
def frame(panel):
    """The panel in pandas, sorted."""
    return panel.toPandas().sort_values(["region_id", "day_idx"]).reset_index(drop=True)
