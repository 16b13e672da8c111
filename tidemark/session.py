"""Session settings and the shared folder for checkpoints and scratch tables."""

from __future__ import annotations

import contextlib
import contextvars
import functools
import tempfile
import uuid
from collections.abc import Iterator

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
# Set to true where a folder without a scheme of its own, or with file:, is a mount all machines share
# and need not be tried.
MOUNTED_CONF = "spark.tidemark.mountedFolder"

# By application and folder, the most cores with which the folder was tried.
_TRIED: dict[tuple[str, str], int] = {}

_SCRATCH = "tidemark-scratch"
# By application and folder, where scratch tables go in it.
_SCRATCH_DIRS: dict[tuple[str, str], str] = {}

_RUN: contextvars.ContextVar[str | None] = contextvars.ContextVar("run", default=None)

_MB = 1024 * 1024


def local_session(cores: str = "*", app: str = "tidemark", **conf: str) -> SparkSession:
    """A local session for tests and measurements; a cluster brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scale_conf(input_bytes: int, cores: int) -> dict[str, str]:
    """Settings for a run over that much input on that many cores.

    Splits grow with the input so that map and reduce tasks stay in the tens of thousands:
    their product is the number of shuffle blocks. Reduce tasks start at twice the cores or
    one per split, whichever is more, and adaptive execution merges those that turn out
    small. Up to 30,000 of them keep one at a few GB for 100 TB, which sorts with spilling.
    """
    split = min(max(input_bytes // 30_000, 128 * _MB), 2048 * _MB)
    reducers = min(max(2 * cores, -(-input_bytes // split)), 30_000)
    return {
        "spark.sql.files.maxPartitionBytes": str(split),
        "spark.sql.shuffle.partitions": str(reducers),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * _MB),
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, named by the session's own setting.

    Only a local session without the setting gets a temporary folder: on a cluster such a
    folder would vanish with the machine that holds it. For the same reason a cluster's
    setting must not be a path of one machine. A path alone does not show that: it may be a
    mount, so it is tried. A cluster's folder may also be set on the context.
    """
    local = _is_local(spark)
    configured = _configured(spark)
    if configured:
        if not local and _scheme(spark, configured) == "file" and spark.conf.get(MOUNTED_CONF, "false") != "true":
            _require_shared(spark, configured)
        return configured.rstrip("/")
    if not local:
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    return _local_dir(spark.sparkContext.applicationId)


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def _configured(spark: SparkSession) -> str | None:
    """The folder of the setting, or else the one that a cluster's context was given by ``setCheckpointDir``."""
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured or _is_local(spark):
        return configured
    found = getattr(spark.sparkContext, "getCheckpointDir", None)
    return found() if found else None


def _scratch_dir(spark: SparkSession, folder: str) -> str:
    """Where scratch tables go in the shared folder.

    Many users may have that folder, as they have ``/tmp``. The first one owns the common scratch
    folder in it, and may not let others in; they get one for their application.
    """
    if not _configured(spark):
        return f"{folder}/{_SCRATCH}"
    key = spark.sparkContext.applicationId, folder
    if key not in _SCRATCH_DIRS:
        common = f"{folder}/{_SCRATCH}"
        _SCRATCH_DIRS[key] = common if _can_write(spark, common) else f"{common}-{key[0]}"
    return _SCRATCH_DIRS[key]


def _can_write(spark: SparkSession, folder: str) -> bool:
    """Whether a folder can be made in this one, which need not be there."""
    path = f"{folder}/made-{uuid.uuid4().hex}"
    found, system = _file_system(spark, path)
    try:
        made = system.mkdirs(found)
    except Py4JJavaError:
        return False
    if made:
        _delete(spark, path)
    return made


def _scheme(spark: SparkSession, path: str) -> str:
    """The file system of a path: its own, or the default one."""
    full = path if ":" in path.split("/")[0] else spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS")
    return full.split(":")[0]


def _require_shared(spark: SparkSession, folder: str) -> None:
    """Stop unless all rows that the executors write into the folder can be read again.

    In a folder that is not shared the driver does not find the files of other machines. It is
    tried once, and again when the cluster has more cores than before; a machine that only
    takes the place of another one is not noticed.
    """
    refused = f"{CHECKPOINT_CONF} is {folder}, a folder of one machine; see {MOUNTED_CONF}"
    try:
        application, cores = spark.sparkContext.applicationId, spark.sparkContext.defaultParallelism
        if cores <= _TRIED.get((application, folder), 0):
            return
        path = f"{_scratch_dir(spark, folder.rstrip('/'))}/tried-{uuid.uuid4().hex}"
        # Every free core gets one of these tasks at once, so every executor does.
        tasks = 2 * cores
        try:
            spark.range(0, tasks, 1, tasks).write.parquet(path)
            found = spark.read.schema("id long").parquet(path).count()
        finally:
            _delete(spark, path)
    except Exception as error:
        raise RuntimeError(refused) from error
    if found != tasks:
        raise RuntimeError(f"{refused}; {tasks} rows were written there and {found} found")
    _TRIED[application, folder] = cores


def _file_system(spark: SparkSession, folder: str) -> tuple[JavaObject, JavaObject]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, folder: str) -> None:
    path, system = _file_system(spark, folder)
    system.delete(path, True)


@functools.cache
def _local_dir(application_id: str) -> str:
    return tempfile.mkdtemp(prefix=f"tidemark-{application_id}-")


def enable_checkpoints(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable, keeping a folder that is already set."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing is created there yet.

    What is written there stays until ``run_scratch`` ends, or, outside of it, until whoever
    owns the shared folder removes it: frames that read it may outlive the function that wrote it.
    """
    run = _RUN.get()
    below = _scratch_dir(spark, shared_dir(spark))
    return f"{below if run is None else f'{below}/{run}'}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def run_scratch(spark: SparkSession) -> Iterator[None]:
    """Scratch tables of one job, in a folder of their own that goes when the job ends."""
    run = f"run-{uuid.uuid4().hex}"
    token = _RUN.set(run)
    try:
        yield
    finally:
        _RUN.reset(token)
        _delete(spark, f"{_scratch_dir(spark, shared_dir(spark))}/{run}")
