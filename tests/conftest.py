"""A session for all tests."""

import pytest
from pyspark.sql import SparkSession

from tessel.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    place = tmp_path_factory.mktemp("warehouse")
    found = session("tests", "local[4]", spark_sql_shuffle_partitions="4", spark_ui_enabled="false", spark_sql_warehouse_dir=str(place), spark_driver_memory="4g")
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()
