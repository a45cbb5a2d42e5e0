import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from ragscope.session import checkpoint_dir, get_spark, release_scratch

    s = get_spark("local[4]", shuffle_partitions=8, app="ragscope-tests")
    checkpoint_dir(s)
    yield s
    release_scratch(s)
