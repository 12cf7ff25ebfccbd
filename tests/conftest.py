import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tarmac.session import build_session

    s = build_session("local[*]", app_name="tarmac-tests", shuffle_partitions=8,
                      extra_conf={"spark.driver.memory": "8g"})
    yield s


@pytest.fixture(scope="session")
def duck_small():
    from oracle_util import duck

    return duck(SF_SMALL)


@pytest.fixture(scope="session")
def duck_mid():
    from oracle_util import duck

    return duck(SF_MID)


@pytest.fixture()
def tmp_dir(tmp_path):
    return str(tmp_path)
