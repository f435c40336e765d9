import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, os.environ.get("PYTHONPATH")) if p)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from waymark.session import session

    s = session("local[4]", 4)
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
