import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{ROOT}/tests:{ROOT}/tests/llm:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quillstrata.session import CHECKPOINT_CONF, get_spark, ship
    from pyspark.sql import SparkSession

    SparkSession.builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config(CHECKPOINT_CONF, str(tmp_path_factory.mktemp("shared"))).config(
        "spark.driver.memory", "4g"
    )
    session = get_spark("tests", "local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()
