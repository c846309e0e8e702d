import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stemweave.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 4, partitions=4)
    # keep small tables in several partitions, so that carrying sums across them is exercised
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    return session
