import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TESTDATA = os.environ.get("SPECULA_TESTDATA", "/root/testdata/sf0.001")


def make_session() -> SparkSession:
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = (SparkSession.builder.master("local[8]").appName("specula")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g")
             .config("spark.local.dir", folder).config("spark.checkpoint.dir", folder + "/checkpoints")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def spark():
    yield make_session()


@pytest.fixture(scope="session")
def folder():
    return TESTDATA
