import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidewire.session import build_session

    root = tmp_path_factory.mktemp("spark")
    session = build_session(
        "tests", "local[4]", **{
            "spark.sql.shuffle.partitions": "4",
            "spark.checkpoint.dir": str(root / "checkpoints"),
            "spark.sql.warehouse.dir": str(root / "warehouse"),
            "spark.driver.memory": "3g",
            "spark.ui.showConsoleProgress": "false"
        }
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
