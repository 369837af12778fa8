import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from ledgerlens.session import get_spark
    s = get_spark("local[*]", app="ledgerlens-tests", shuffle_partitions=8)
    yield s


@pytest.fixture
def write_text(tmp_path):
    """Write a fixture string to a file; returns its path."""
    def _write(name: str, text: str) -> str:
        p = tmp_path / name
        p.write_bytes(text.encode("utf-8"))
        return str(p)
    return _write
