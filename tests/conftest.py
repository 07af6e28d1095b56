import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
os.environ.setdefault("OMP_NUM_THREADS", "1")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tesserine.session import session

    shared = tmp_path_factory.mktemp("shared")
    made = session(
        "tests", "local[4]", spark_sql_shuffle_partitions="4", spark_driver_memory="4g", spark_ui_enabled="false", spark_ui_showConsoleProgress="false",
        spark_sql_codegen_fallback="false",  # a stage that can't be compiled is an error here
        spark_checkpoint_dir=f"file://{shared}", spark_sql_warehouse_dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
