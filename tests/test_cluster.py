"""Queries that write to the shared folder, on executors of their own and with a master that is not local.

The folder has no scheme, as where all machines have a mount under one path.
"""

import json
import os
import subprocess
import sys
from pathlib import Path

import pyspark
import pytest

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")

NAMES = """
label_encode
label_encode_nulls
log_run
model_report
label_encode_shuffled
predict
run_batch
predict_proba
run_stream
save_model
scan_csv
run_stream_batches
scan_csv_inferred
scan_stream
scan_table
scan_csv_raw
scored_rows
split_shape
select_features
stratified_split
stream_available_now
stream_bronze
""".split()

_RUN = """
import json, sys
from pyspark.sql import SparkSession
import __spark_entry__ as entry
from oracle import connect, differences

folder, sf_dir, *names = sys.argv[1:]
conf = {
    "spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "900m", "spark.ui.enabled": "false",
    "spark.checkpoint.dir": folder, "spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC",
}
spark = SparkSession.builder.config(map=conf).getOrCreate()
spark.sparkContext.master = "spark://h:7077"
con = connect(sf_dir)
for name in names:
    try:
        found = differences(entry.queries()[name](spark, sf_dir), con, entry.oracle_sql()[name])
    except Exception as error:
        found = [f"{type(error).__name__}: {str(error)[:300]}"]
    print(json.dumps([name, found]), flush=True)
spark.stop()
"""


@pytest.fixture(scope="module")
def found(tmp_path_factory):
    """What differs from the SQL's rows, by query."""
    folder = tmp_path_factory.mktemp("cluster")
    tests = os.path.dirname(os.path.abspath(__file__))
    # The executors' logs go to work in Spark's home.
    home = folder / "spark"
    home.mkdir()
    for part in Path(pyspark.__file__).parent.iterdir():
        if part.name != "work":
            (home / part.name).symlink_to(part)
    env = os.environ | {"PYTHONPATH": f"{os.path.dirname(tests)}{os.pathsep}{tests}", "SPARK_HOME": str(home)}
    env |= {"SPARK_SCALA_VERSION": "2.13"}
    command = [sys.executable, "-c", _RUN, str(folder / "mount"), SF_DIR, *NAMES]
    done = subprocess.run(command, cwd=folder, env=env, capture_output=True, text=True, timeout=1800)
    assert done.returncode == 0, done.stderr[-2000:]
    return dict(map(json.loads, done.stdout.splitlines()))


@pytest.mark.parametrize("name", NAMES)
def test_query_on_a_cluster_equals_sql(found, name):
    assert found[name] == []
