import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from darkroom.session import local_session

    s = local_session(4, "tests")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s


@pytest.fixture()
def staging(spark):
    from darkroom.plans.staging import Staging

    return Staging(spark, "test")
