import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from almanac.session import local_session, reachable

    session = local_session(8, 4, "6g", "tests")
    session.sparkContext.setLogLevel("ERROR")
    reachable(session)
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()
