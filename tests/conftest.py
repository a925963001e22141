import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from codestrata.session import build_session, shared_dir

    session = build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__checkpoint__dir=tmp_path_factory.mktemp("shared").as_uri(), spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    shared_dir(session)
    yield session
    session.stop()
