import os
import subprocess
import sys
import types

import pytest
from pyspark.errors import AnalysisException

from tidemark.session import enable_checkpoints, run_scratch, scale_conf, scratch_path, shared_dir


class Fake:
    """A session that only knows its settings and master."""

    def __init__(self, master, **conf):
        self.conf = types.SimpleNamespace(get=lambda key, default=None: conf.get(key, default))
        hadoop = types.SimpleNamespace(get=lambda key: conf.get(key, "file:///"))
        java = types.SimpleNamespace(hadoopConfiguration=lambda: hadoop)
        self.sparkContext = types.SimpleNamespace(master=master, applicationId=f"app-{id(self)}", _jsc=java)


def test_the_sessions_own_folder_is_used():
    settings = {"spark.checkpoint.dir": "hdfs://shared/checkpoints/"}
    assert shared_dir(Fake("yarn", **settings)) == "hdfs://shared/checkpoints"
    assert shared_dir(Fake("local[2]", **settings)) == "hdfs://shared/checkpoints"


def test_a_cluster_without_a_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Fake("yarn"))


@pytest.mark.parametrize("path", ["/tmp/x", "file:/x", "file:///x"])
def test_a_cluster_with_a_folder_of_one_machine_is_refused(path):
    with pytest.raises(RuntimeError, match="one machine"):
        shared_dir(Fake("spark://h:7077", **{"spark.checkpoint.dir": path}))
    mounted = {"spark.checkpoint.dir": path, "spark.tidemark.mountedFolder": "true"}
    assert shared_dir(Fake("spark://h:7077", **mounted)) == path
    default = {"spark.checkpoint.dir": "/shared", "fs.defaultFS": "hdfs://h"}
    assert shared_dir(Fake("yarn", **default)) == "/shared"


class Cluster:
    """A real session that says it is a cluster's, with a folder that has no scheme of its own."""

    def __init__(self, spark, folder, lost=0):
        self.read, self._jvm, self.tried, self._spark, self._lost = spark.read, spark._jvm, 0, spark, lost
        settings = {"spark.checkpoint.dir": folder}
        self.conf = types.SimpleNamespace(get=lambda key, default=None: settings.get(key, default))
        self.sparkContext = types.SimpleNamespace(
            master="spark://h:7077", applicationId="app", defaultParallelism=2, _jsc=spark.sparkContext._jsc
        )

    def range(self, start, end, step, partitions):
        self.tried += 1
        return self._spark.range(start, end - self._lost, step, partitions)


def test_a_mount_is_known_by_trying_it(spark, tmp_path):
    folder = str(tmp_path / "mount")
    cluster = Cluster(spark, folder)
    assert shared_dir(cluster) == shared_dir(cluster) == folder
    assert cluster.tried == 1
    # More machines: they may lack the mount.
    cluster.sparkContext.defaultParallelism = 4
    assert shared_dir(cluster) == folder
    assert cluster.tried == 2
    assert os.listdir(f"{folder}/tidemark-scratch") == []


def test_a_folder_in_which_rows_get_lost_is_refused(spark, tmp_path):
    folder = str(tmp_path / "own")
    for _ in range(2):
        with pytest.raises(RuntimeError, match="one machine.*4 rows were written there and 3 found"):
            shared_dir(Cluster(spark, folder, lost=1))


def test_queries_on_a_cluster_with_a_mounted_folder(tmp_path):
    """Executors of their own, and a session that does not call itself local."""
    names = ["scan_csv", "label_encode", "split_shape", "stream_bronze"]
    code = f"""
from pyspark.sql import SparkSession
import __spark_entry__ as entry
conf = {{
    "spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "900m", "spark.ui.enabled": "false",
    "spark.checkpoint.dir": {str(tmp_path / "mount")!r}, "spark.sql.shuffle.partitions": "4",
}}
spark = SparkSession.builder.config(map=conf).getOrCreate()
spark.sparkContext.master = "spark://h:7077"
for name in {names}:
    print(name, entry.queries()[name](spark, "/root/testdata/sf0.001").count(), flush=True)
spark.stop()
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"PYTHONPATH": root}
    command = [sys.executable, "-c", code]
    done = subprocess.run(command, cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert [line.split()[0] for line in done.stdout.splitlines()] == names
    assert all(int(line.split()[1]) > 0 for line in done.stdout.splitlines())


@pytest.mark.parametrize("taken", ["tidemark-scratch", None])
def test_scratch_tables_go_where_they_can_be_written(spark, tmp_path, taken):
    """A file stands for another user's folder: the tests may run as a user who can write anywhere."""
    if taken:
        (tmp_path / taken).write_text("")
    cluster = Cluster(spark, str(tmp_path))
    cluster.sparkContext.applicationId = f"app-{taken}"
    path = scratch_path(cluster, "x")
    own = "tidemark-scratch" if taken is None else f"tidemark-scratch-app-{taken}"
    assert os.path.dirname(path) == f"{tmp_path}/{own}"
    assert cluster.tried == 1
    with run_scratch(cluster):
        inside = scratch_path(cluster, "x")
        spark.range(3).write.parquet(inside)
        assert spark.read.parquet(inside).count() == 3
    assert os.listdir(tmp_path / own) == []


def test_a_folder_set_on_the_context_is_used(spark, tmp_path):
    cluster = Cluster(spark, None)
    cluster.sparkContext.applicationId = "app-context"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(cluster)
    cluster.sparkContext.getCheckpointDir = lambda: f"file:{tmp_path}/set"
    assert shared_dir(cluster) == f"file:{tmp_path}/set"
    assert scratch_path(cluster, "x").startswith(f"file:{tmp_path}/set/tidemark-scratch/x-")


def test_a_jobs_scratch_goes_with_it(spark):
    with run_scratch(spark):
        path = scratch_path(spark, "x")
        spark.range(3).write.parquet(path)
        assert spark.read.parquet(path).count() == 3
    outside = scratch_path(spark, "y")
    spark.range(3).write.parquet(outside)
    with pytest.raises(AnalysisException):
        spark.read.parquet(path)
    assert spark.read.parquet(outside).count() == 3


def test_a_local_session_gets_one_folder():
    fake = Fake("local[2]")
    assert shared_dir(fake) == shared_dir(fake)
    assert scratch_path(fake, "x") != scratch_path(fake, "x")


def test_checkpoints_can_be_written(spark):
    enable_checkpoints(spark)
    assert spark.range(3).checkpoint().count() == 3


def test_settings_grow_with_the_input():
    small = scale_conf(10 * 2**30, 64)
    assert small["spark.sql.files.maxPartitionBytes"] == str(128 * 2**20)
    assert small["spark.sql.shuffle.partitions"] == "128"
    large = scale_conf(100 * 10**12, 8000)
    assert int(large["spark.sql.files.maxPartitionBytes"]) == 2048 * 2**20
    assert large["spark.sql.shuffle.partitions"] == "30000"
    middle = scale_conf(10 * 10**12, 4000)
    assert int(middle["spark.sql.files.maxPartitionBytes"]) == 10 * 10**12 // 30_000
    assert int(middle["spark.sql.shuffle.partitions"]) == 30_000
