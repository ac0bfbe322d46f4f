import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.log.level": "ERROR"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    yield session
    session.stop()


@pytest.fixture
def rows():
    """A table's rows as sorted tuples."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
