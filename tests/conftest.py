import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from graphloom.session import local_session

    s = local_session(cpus=4, memory="4g")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"


def rows(df):
    """The rows of a DataFrame as sorted tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
