import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pressroom.session import build_session
    # PRESSROOM_TEST_AQE=false runs the suite with adaptive execution off (plans differ:
    # e.g. joins of a frame with its own checkpointed derivative must still resolve).
    extra = {"spark.sql.adaptive.enabled": os.environ.get("PRESSROOM_TEST_AQE", "true")}
    s = build_session(master="local[*]", shuffle_partitions=8, app="pressroom-tests", extra=extra)
    yield s
    s.stop()
