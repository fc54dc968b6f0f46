import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    import __spark_entry__ as e
    from tests.oracle import session

    s = session()
    e._ship(s)
    yield s
    s.stop()
