from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def events(spark):
    """Build ``events(seq, ts, raw)`` from payloads (dicts or raw text), one second apart."""
    import datetime
    import json

    def make(payloads):
        start = datetime.datetime(2024, 1, 1)
        rows = [
            (n, start + datetime.timedelta(seconds=n), p if isinstance(p, str) or p is None else json.dumps(p))
            for n, p in enumerate(payloads)
        ]
        return spark.createDataFrame(rows, "seq bigint, ts timestamp, raw string")

    return make
