import sys
from datetime import date
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ripplepanel.policy import Policy  # noqa: E402
from ripplepanel.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", master="local[8]", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def policy():
    return Policy(
        shock=date(2025, 1, 5), core=(1, 2, 3), buffer=(4,), airports=(1, 6),
        borough_codes={"Manhattan": 1, "Bronx": 2}, holidays=(date(2025, 1, 1),))
