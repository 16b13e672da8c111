"""Queries whose shared folder holds a scratch folder they cannot write in, as one of another user.

A file stands for it: the tests may run as a user who can write anywhere.
"""

import json
import os
import subprocess
import sys

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
import __spark_entry__ as entry
from oracle import connect, differences
from tidemark.session import local_session

folder, sf_dir, *names = sys.argv[1:]
spark = local_session("4", **{"spark.checkpoint.dir": folder, "spark.sql.shuffle.partitions": "4"})
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
    folder = tmp_path_factory.mktemp("shared")
    (folder / "tidemark-scratch").write_text("")
    tests = os.path.dirname(os.path.abspath(__file__))
    env = os.environ | {"PYTHONPATH": f"{os.path.dirname(tests)}{os.pathsep}{tests}"}
    command = [sys.executable, "-c", _RUN, str(folder), SF_DIR, *NAMES]
    done = subprocess.run(command, cwd=folder, env=env, capture_output=True, text=True, timeout=1800)
    assert done.returncode == 0, done.stderr[-2000:]
    return dict(map(json.loads, done.stdout.splitlines()))


@pytest.mark.parametrize("name", NAMES)
def test_query_beside_anothers_scratch_equals_sql(found, name):
    assert found[name] == []
