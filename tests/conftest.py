import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from cohortloom.session import build_session, local_checkpoint_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "12g",
        "spark.sql.ui.retainedExecutions": "5", "spark.ui.retainedJobs": "20", "spark.ui.retainedStages": "20"})
    session.sparkContext.setLogLevel("OFF")
    local_checkpoint_dir(session)
    yield session
    session.stop()
