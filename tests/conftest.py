import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from recollect.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(8, "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g",
                                     "spark.checkpoint.dir": str(tmp_path_factory.mktemp("staging"))})
    yield s
    s.stop()
