import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))


@pytest.fixture(scope="session")
def spark():
    from webcairn.session import local_session

    session = local_session("8", "tests")
    session.sparkContext.setLogLevel("ERROR")
    return session
