import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from fillwise.session import local_session

    session = local_session(
        8,
        spark__checkpoint__dir="file://" + tempfile.mkdtemp(prefix="spark-test-"),
        spark__sql__warehouse__dir=tempfile.mkdtemp(prefix="spark-wh-"),
    )
    yield session
    session.stop()
