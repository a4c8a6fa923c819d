from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

HERE = Path(__file__).resolve().parent
sys.path[:0] = [str(HERE), str(HERE.parent)]

from compare import star_views  # noqa: E402
from edge_tables import edge_tables, empty_tables  # noqa: E402
from spanledger.session import session  # noqa: E402
from star import STAR, both_engines  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session(
        "tests",
        4,
        **{
            "spark.master": "local[8]",
            "spark.driver.memory": "6g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def star_db():
    connection = duckdb.connect()
    star_views(connection, STAR)
    return connection


@pytest.fixture(scope="session")
def edge(spark, tmp_path_factory):
    return both_engines(edge_tables(spark), tmp_path_factory.mktemp("edge"))


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return both_engines(empty_tables(spark), tmp_path_factory.mktemp("empty"))
