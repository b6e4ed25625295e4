import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from ledgerloom.session import get_spark

    s = get_spark("local[4]", 4, spark__driver__memory="4g", spark__checkpoint__dir=tempfile.mkdtemp(prefix="ledgerloom-test-"))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
