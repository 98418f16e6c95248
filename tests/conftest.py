import os
import sys

os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.environ.get("PYTHONPATH", "")])
sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

import pytest
from helpers import TWENTY, A, D, rows_of
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def twenty(spark):
    return spark.createDataFrame(rows_of(TWENTY), "row_id int, uid long, lat double, lng double, datetime timestamp_ntz").cache()


@pytest.fixture(scope="session")
def twenty_three(spark):
    users = {**TWENTY, 7: [(4, 10, A), (4, 11, A), (5, 12, D)]}
    return spark.createDataFrame(rows_of(users), "row_id int, uid long, lat double, lng double, datetime timestamp_ntz").cache()
