import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"  # for the workers
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    folder = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(folder / "shared"))
        .config("spark.sql.warehouse.dir", str(folder / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def value(spark):
    """The value of a column function for literal arguments (strings, lists of strings, numbers)."""
    from pyspark.sql import functions as F

    def kind(x):
        return "array<string>" if isinstance(x, list) else "double" if isinstance(x, float) else "long" if isinstance(x, int) else "string"

    def run(function, *args):
        names = [f"c{i}" for i in range(len(args))]
        rows = spark.createDataFrame([args], ", ".join(f"{n} {kind(a)}" for n, a in zip(names, args)))
        return rows.select(function(*map(F.col, names)).alias("r")).first()["r"]

    return run
