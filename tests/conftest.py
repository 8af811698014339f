import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tessera.session import local_session, share_code, shared_dir  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    shared_dir(session)
    share_code(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
