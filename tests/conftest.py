import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tripmill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    settings = {"spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints"))}
    session = local_session(os.environ.get("TEST_CPUS", "4"), "tests", settings)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(autouse=True)
def no_leftover_cache(spark):
    yield
    spark.catalog.clearCache()
