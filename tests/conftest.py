import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
for folder in (ROOT, ROOT / "tests"):
    if str(folder) not in sys.path:
        sys.path.insert(0, str(folder))

from paperloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        master="local[4]",
        shuffle_partitions=4,
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
            # The default, which jobs must bear in sessions they did not build.
            "spark.sql.unionOutputPartitioning": "true",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def plan(spark):
    """Physical plan of a DataFrame as text."""
    modes = spark._jvm.org.apache.spark.sql.execution.ExplainMode

    def text_of(frame):
        return frame._jdf.queryExecution().explainString(modes.fromString("formatted"))

    return text_of
