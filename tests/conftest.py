import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from atrium.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        # small data: planning and compiling cost more than running
        "spark.sql.codegen.wholeStage": "false", "spark.sql.adaptive.enabled": "false"})
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def tables(spark):
    from atrium.sources.fixtures import Tables

    return Tables(spark, "/root/testdata/sf0.001")
