from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tapeloom.session import local_session

    session = local_session(4, partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import oracle

    return oracle.connect(SMALL)


@pytest.fixture(scope="session")
def small():
    return SMALL
