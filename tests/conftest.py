import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from sway.session import get_spark

    s = get_spark("local[*]", app="sway-tests", shuffle_partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def one(spark, value, name="x"):
    """Evaluate a Column expression over a single string row."""
    from pyspark.sql import types as T

    return spark.createDataFrame([(value,)], T.StructType([T.StructField(name, T.StringType())]))
