import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from stepwise.session import checkpoint_dir, configure

    b = (SparkSession.builder.master("local[4]").appName("stepwise-tests")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", "8"))
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    configure(s)
    # tests only: a scratch checkpoint folder when the deployment names none
    if not s.sparkContext._jsc.sc().getCheckpointDir().isDefined() and not s.conf.get("spark.checkpoint.dir", None):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="stepwise-test-ckpt-"))
    checkpoint_dir(s)
    yield s
    s.stop()


def rows(df, *cols):
    """Sorted list of tuples (None sorts first) for order-insensitive comparison."""
    cols = cols or tuple(df.columns)
    out = [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]
    return sorted(out, key=lambda t: tuple((x is not None, x) for x in t))
