import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from vellum.session import checkpoint_dir, local_session

    s = local_session(cores=4, shuffle_partitions=4, app="vellum-tests")
    checkpoint_dir(s)
    yield s
    s.stop()


SF_SMOKE = "/root/testdata/sf0.001"
