"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FOLDERS: dict[str, str] = {}
#: The tables staged in each open scratch scope, outermost first.
_SCRATCH: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    scratch = tempfile.mkdtemp(prefix="billwright-")
    atexit.register(shutil.rmtree, scratch, ignore_errors=True)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("billwright")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", scratch)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    Only a local master without that setting gets one for the session, a
    temporary folder of this machine that goes when the program ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_FOLDERS:
            _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="billwright-")
            atexit.register(shutil.rmtree, _LOCAL_FOLDERS[app], ignore_errors=True)
        base = _LOCAL_FOLDERS[app]
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@contextmanager
def batch_settings(spark: SparkSession) -> Iterator[None]:
    """A trigger's session, planned as a batch while its rows are worked on.

    What looks small as a compressed file may be large in memory. Here tables
    are broadcast by the size that tasks found them to have.
    """
    wanted = {"spark.sql.adaptive.enabled": "true", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    wanted["spark.sql.adaptive.autoBroadcastJoinThreshold"] = spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) or "10MB"
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@contextmanager
def scratch(spark: SparkSession, inner: bool = False) -> Iterator[None]:
    """Tables staged within it are packed tighter and deleted when it ends, shuffle files as soon as the job that wrote them ends.

    Tables that are handed ``out`` go to a scope around this one, or stay if
    there is none. Other rows that were made here can't be read afterwards. An
    ``inner`` scope does nothing unless a caller opened one around it.
    """
    scopes = _SCRATCH.get()
    if inner and not scopes:
        yield
        return
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}
    before, paths = {k: spark.conf.get(k, None) for k in wanted}, []
    opened = _SCRATCH.set((*scopes, paths))
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        _SCRATCH.reset(opened)
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
        for path in paths:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    For costly rows that several later steps use: they read the table instead
    of working the rows out again, and a lost executor costs only its reads.
    Within ``scratch`` the table goes with the scope.
    """
    return handed(df, purpose, out=0)


def handed(df: DataFrame, purpose: str, out: int = 1) -> DataFrame:
    """As ``staged``, for a table that outlives the ``out`` innermost scopes."""
    path = shared_folder(df.sparkSession, purpose)
    scopes = _SCRATCH.get()
    if len(scopes) > out:
        scopes[-1 - out].append(path)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
