"""One local session for all tests; the workers find the package by PYTHONPATH."""

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from annolith.session import local_session

    session = local_session(4, "4g", spark__sql__shuffle__partitions="4", spark__sql__autoBroadcastJoinThreshold="1m")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
