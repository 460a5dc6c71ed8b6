import pytest

from lodestrata.session import get_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    tmp = tmp_path_factory.mktemp("spark")
    s = get_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.local.dir": str(tmp / "local"), "spark.checkpoint.dir": str(tmp / "checkpoint"), "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "3g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
