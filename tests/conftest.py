import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from landgauge.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(partitions=8)
    yield session
    session.stop()


@pytest.fixture
def hot(spark):
    """Every group over 40 rows counts as hot, so the range-cut paths run on small data."""
    spark.conf.set("landgauge.hotRows", "40")
    yield spark
    spark.conf.unset("landgauge.hotRows")
