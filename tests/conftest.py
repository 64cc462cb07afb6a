import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession
    session = (SparkSession.builder.master("local[4]").appName("tests").config("spark.ui.enabled", "false")
               .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("stage")))
               .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
               .config("spark.driver.memory", "4g").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def readings(spark):
    """readings({customer: [kwh, ...]}) -> daily readings from 2024-01-01 on."""
    import datetime as dt

    def build(values):
        rows = [(c, dt.date(2024, 1, 1) + dt.timedelta(days=i), None if v is None else float(v))
                for c, series in values.items() for i, v in enumerate(series)]
        return spark.createDataFrame(rows, "customer_id string, date date, consumption_kwh double")
    return build
