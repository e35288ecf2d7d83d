import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from ridgeway.session import get_spark, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark("tests", 4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.sql.autoBroadcastJoinThreshold": "-1"})
    s.sparkContext.setLogLevel("OFF")
    ship(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
