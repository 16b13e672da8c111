"""Every registered query against its SQL, at the smallest scale."""

import os
import subprocess
import sys

import pytest
from oracle import connect, differences

import __spark_entry__ as entry
from tidemark import catalog
from tidemark.session import scratch_path, shared_dir

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")

# Queries whose values SQL cannot tell.
ROWS_ONLY: set[str] = set()


# One query per operator of the survey's inventory.
INVENTORY = """
scan_csv scan_table scan_stream inspect_schema
write_overwrite write_stream_append encode_events save_model log_run
project derive rename flatten_struct cast_types select_features
drop_null_rows filter_null filter_not_in compare case_when
dedup_key row_count distinct_count null_counts
clean_blank_numeric clean_yes_no bronze_to_silver
feat_equals feat_not_equals feat_guarded_ratio feat_threshold silver_to_gold
dq_not_null dq_unique dq_in_set dq_min_rows dq_report dq_event_contract
fn_trim fn_lower fn_divide fn_from_json parse_events fn_current_timestamp fn_coalesce_zero fn_format_id fn_round
fn_iso_timestamp generate_events
label_encode stratified_split train_gbt train_rounds predict_proba predict auc_roc confusion classification_report
stream_available_now stream_append stream_checkpoint stream_bronze
run_batch run_stream
""".split()


def test_inventory_is_covered():
    assert set(INVENTORY) <= set(entry.queries())


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns[0] == "customer_id" and len(df.columns) == 15


def test_every_sql_has_a_query():
    assert set(catalog.QUERIES) - set(catalog.SQL) == ROWS_ONLY
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.SQL) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, con, name):
    assert differences(entry.queries()[name](spark, SF_DIR), con, entry.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_model_query(spark, name):
    assert entry.queries()[name](spark, SF_DIR).count() > 0


def test_shared_folder_is_the_one_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_dir(spark) == named.rstrip("/")
    assert scratch_path(spark, "x").startswith(shared_dir(spark))
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


@pytest.mark.parametrize("missing", ["tidemark.llm", "corpus_pipeline", "public_tokenizers", "xxhash"])
def test_core_queries_without_the_text_operators(missing):
    """Whatever the text operators lack, the other queries are there."""
    code = f"""
import sys
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name == {missing!r} or name.startswith({missing + "."!r}):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as entry
from tidemark import catalog
assert set(entry.queries()) == set(catalog.QUERIES) and set(entry.oracle_sql()) == set(catalog.SQL)
"""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert "the text operators are left out" in done.stderr
