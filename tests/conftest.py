from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from lanewright.session import local_session, ship

    # interpreted plans: many tiny queries spend their time on compiling otherwise
    fast = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.adaptive.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    SparkSession.builder.config(map=fast)
    session = local_session(cores=4, partitions=2, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()


@pytest.fixture
def home(spark, tmp_path):
    from lanewright.home import Home

    return Home(spark, str(tmp_path / "home"))
