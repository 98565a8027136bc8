import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from pointloom.session import get_spark

    s = get_spark("tests", cpus=8)
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()
