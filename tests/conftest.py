from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vitrina.session import local_session  # noqa: E402

SF001 = "/root/testdata/sf0.01"
SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", 8, app="vitrina-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck_sf001():
    from tests.compare import duck

    return duck(SF001)
