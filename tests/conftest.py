import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("COLDLAKE_SCRATCH", tempfile.mkdtemp(prefix="coldlake-test-", dir="/tmp"))
    from coldlake.session import local_session
    s = local_session("*", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="coldlake-t-", dir=os.environ.get("COLDLAKE_SCRATCH", "/tmp"))
