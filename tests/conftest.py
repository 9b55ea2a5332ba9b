from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from graphloom.session import get_session

    s = get_session(cores=4, partitions=4, app="tests")
    s.sparkContext.setLogLevel("ERROR")
    return s
