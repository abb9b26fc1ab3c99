import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[*]").appName("deskline-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    from deskline.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(s)  # the configured shared folder; a temporary one only if none is set
    yield s


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("DESKLINE_TEST_SF", "/root/testdata/sf0.001")
