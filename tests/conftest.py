import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("COLONNADE_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    from colonnade.session import get_session

    session = get_session("4", "tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("test tables are not here")
    return folder
