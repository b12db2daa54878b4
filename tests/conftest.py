import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from transient_lake.session import checkpoint_dir, get_spark

    import tempfile

    s = get_spark("local[4]", 4, extra={"spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="tl-wh-")})
    checkpoint_dir(s)  # sets a local folder only because none is configured
    yield s
    s.stop()
