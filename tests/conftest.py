import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

FIXTURES = os.path.join(os.path.dirname(os.path.abspath(__file__)), "fixtures")
SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from snapweave.session import build_session
    s = build_session("local[4]", 4)
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="snapweave-test-")
