import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from upswell.session import build_session

    s = build_session(master="local[*]", shuffle_partitions=8, extra={"upswell.text.partitions": "8"})
    yield s


@pytest.fixture()
def tmpdir_path(tmp_path):
    return str(tmp_path)
