import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from billsift.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warehouse = tmp_path_factory.mktemp("warehouse")
    return local_session(8, partitions=8, settings={"spark.sql.warehouse.dir": f"file://{warehouse}"})


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
