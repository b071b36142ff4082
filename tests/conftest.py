import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[2]")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.codegen.wholeStage", "false")
        .config("spark.driver.extraJavaOptions", "-XX:TieredStopAtLevel=1")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from coverset.session import attach

    return attach(session)


@pytest.fixture(scope="session")
def vec_tiny(spark):
    points = [0.0, 1.0, 2.0, 10.0, 11.0, 30.0]
    return spark.createDataFrame([(i, [x]) for i, x in enumerate(points)], "id long, item array<double>").persist()


@pytest.fixture(scope="session")
def fp_tiny(spark):
    sets = [[1, 2, 3, 4], [1, 2, 3, 4], [1, 2, 3, 5], [7, 8], [7, 8, 9], []]
    return spark.createDataFrame(list(enumerate(sets)), "id long, item array<int>").persist()
