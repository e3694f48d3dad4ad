import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tablewright.session import local_session

    session = local_session(8, "tests", "6g")
    yield session
    session.stop()


@pytest.fixture()
def small_blocks(monkeypatch):
    """Limits so low that a few thousand rows take the paths of large tables."""
    from tablewright.operators import knn
    from tablewright.plans import orderstats, ranks

    monkeypatch.setattr(orderstats, "DIRECT_ROWS", 200)
    monkeypatch.setattr(orderstats, "SKETCH_ACCURACY", 50)
    monkeypatch.setattr(ranks, "BUCKET_ROWS", 100)
    monkeypatch.setattr(knn, "BLOCK_DONORS", 150)
    monkeypatch.setattr(knn, "BLOCK_QUERIES", 40)
