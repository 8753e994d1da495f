import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from granaria.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session(
        "tests",
        **{
            "spark.master": "local[4]", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g",
            "spark.default.parallelism": "4",
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
