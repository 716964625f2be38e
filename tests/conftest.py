import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from alertspark.session import get_spark, shared_dir

    s = get_spark("local[4]", 8, app_name="alertspark-tests")
    shared_dir(s)
    yield s
