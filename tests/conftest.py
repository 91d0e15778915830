import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from adperf.session import build_session  # noqa: E402
from adperf.sources import storage  # noqa: E402

storage.STATE_BUCKETS = 4  # small stores

SF_SMOKE = "/root/testdata/sf0.001"
SF_SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", 4, driver_memory="4g")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="adperf-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture()
def tmp_root():
    return tempfile.mkdtemp(prefix="adperf-test-")
