"""A session for all tests, with its shared folder."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 4g pyspark-shell")
    from matchloom.session import build_session

    shared = "file://" + str(tmp_path_factory.mktemp("shared"))
    session = build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__checkpoint__dir=shared)
    yield session
    session.stop()


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small() -> str:
    return SMALL
