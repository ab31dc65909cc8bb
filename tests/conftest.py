import os
import tempfile

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="ruleframe-tests-"), "spark.driver.memory": "4g", "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="ruleframe-warehouse-"),
    }
    session = SparkSession.builder.master(os.environ.get("RULEFRAME_MASTER", "local[4]")).appName("ruleframe-tests").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    """The smallest of the driver's table sets."""
    path = os.environ.get("RULEFRAME_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(path):
        pytest.skip(f"{path} is not there")
    return path
