import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")),
    }
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def panel(spark):
    """A function that makes a daily panel from {series: values}; None is a missing row."""
    import datetime as dt

    def make(series, **columns):
        rows = []
        for name, values in series.items():
            for i, y in enumerate(values):
                if y is not None:
                    rows.append((name, dt.datetime(2020, 1, 1) + dt.timedelta(days=i), float(y), *(float(c[i]) for c in columns.values())))
        return spark.createDataFrame(rows, "unique_id string, ds timestamp_ntz, y double" + "".join(f", {c} double" for c in columns))

    return make
