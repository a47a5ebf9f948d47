import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from poolshift.session import build_session
    ckpt = tempfile.mkdtemp(prefix="poolshift-test-ckpt-")
    s = build_session(master="local[4]", shuffle_partitions=8, driver_memory="12g",
                      extra={"spark.checkpoint.dir": ckpt,
                             "spark.sql.autoBroadcastJoinThreshold": "10m"})
    yield s
    s.stop()
