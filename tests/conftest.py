from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from almoner.model import TABLES, Tables  # noqa: E402
from almoner.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, str(tmp_path_factory.mktemp("checkpoint")))
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_tables(spark):
    """Tables from a dict of rows; tables that are not given are empty."""

    def make(**rows) -> Tables:
        frames = {
            t: spark.createDataFrame(rows.get(t, []), spec.schema).coalesce(2)
            for t, spec in TABLES.items()
        }
        return Tables(frames.__getitem__)

    return make

