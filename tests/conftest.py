import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "tests", **{"spark.sql.shuffle.partitions": "8"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def ansi(spark):
    """Switch ANSI mode for one test."""

    def switch(on: bool):
        spark.conf.set("spark.sql.ansi.enabled", str(on).lower())

    before = spark.conf.get("spark.sql.ansi.enabled")
    yield switch
    spark.conf.set("spark.sql.ansi.enabled", before)
