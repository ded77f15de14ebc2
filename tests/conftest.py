import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

# The small worked example: rows are items, columns s1..s5 are sources.
EXAMPLE = [
    ("o1", "p1", ["abc", "abc", "abd", "abd", "abd"], "abc"),
    ("o1", "p2", ["10", "10", "11", "11", "20"], "10"),
    ("o1", "p3", ["u", "u", "w", "w", "u"], "u"),
    ("o2", "p1", ["xyz", "xyz", "xya", "xya", "xyz"], "xyz"),
    ("o2", "p2", ["30", "31", "31", "31", None], "30"),
    ("o2", "p3", ["m", "m", "n", "n", "m"], "m"),
]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("truthloom-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def example_rows():
    return [
        (o, p, value, f"s{i}")
        for o, p, values, _ in EXAMPLE
        for i, value in enumerate(values, 1)
        if value is not None
    ]


@pytest.fixture(scope="session")
def example(spark, example_rows):
    return spark.createDataFrame(example_rows, "object string, property string, value string, source string").cache()


@pytest.fixture(scope="session")
def example_truth(spark):
    rows = [(o, p, truth) for o, p, _, truth in EXAMPLE]
    return spark.createDataFrame(rows, "object string, property string, value string").cache()
