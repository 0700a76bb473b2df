import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from daymark.session import get_spark

    session = get_spark("tests", cores=os.environ.get("TEST_CPUS", "8"), shuffle=4)
    yield session
    session.stop()
