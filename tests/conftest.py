import os
import tempfile

import pytest

from headwise.session import build_session

os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "headwise-tests",
        **{
            "spark.master": "local[8]",
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="headwise-"),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
