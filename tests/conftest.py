import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from packlake.session import session

    root = tmp_path_factory.mktemp("shared")
    s = session("local[4]", 4, **{"spark.ui.enabled": "false", "spark.driver.memory": "3g", "spark.checkpoint.dir": f"file://{root}", "spark.sql.warehouse.dir": f"{root}/warehouse"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
