import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from casewise.session import get_spark
    scratch = tempfile.mkdtemp(prefix="casewise-tests-")
    s = get_spark("local[*]", app_name="casewise-tests", shuffle_partitions=8,
                  extra={"spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
                         "spark.local.dir": os.path.join(scratch, "local")})
    yield s
    s.stop()
