import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from stratakit.session import local_session

    s = local_session(4, "stratakit-tests")
    s.conf.set("spark.sql.shuffle.partitions", "8")
    yield s
