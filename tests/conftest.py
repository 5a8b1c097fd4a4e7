import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
for folder in (HERE, os.path.dirname(HERE)):
    if folder not in sys.path:
        sys.path.insert(0, folder)


@pytest.fixture(scope="session")
def spark():
    from pdforge.session import get_session
    s = get_session("local[*]", app_name="pdforge-tests", shuffle_partitions=8)
    yield s
    s.stop()
