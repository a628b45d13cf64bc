"""Session and table helpers."""

from __future__ import annotations

import atexit
import contextlib
import functools
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that tests and the bench share."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("odweave")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise KeyError(name)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reject_streaming(df: DataFrame, operator: str) -> None:
    """Operators that need their whole input refuse a stream."""
    if df.isStreaming:
        raise ValueError(f"{operator} needs its complete input and cannot run on a streaming DataFrame")


# --- the folder that driver and executors share -----------------------------------------------------------------

#: Folders handed out so far, those of the innermost scratch() last.
_SCOPES: list[list[str]] = [[]]


def shared_root(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir.

    Where that is unset, a local session (whose executors are the driver) gets a folder of this machine; a cluster
    raises, as executors elsewhere would write to disks of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _local_root()
    return f"{base.rstrip('/')}/odweave/{spark.sparkContext.applicationId}"


@functools.cache
def _local_root() -> str:
    path = tempfile.mkdtemp(prefix="odweave-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return "file://" + path


def shared_dir(spark: SparkSession) -> str:
    """The name of a new folder below shared_root."""
    path = f"{shared_root(spark)}/{uuid.uuid4().hex}"
    _SCOPES[-1].append(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """df as a table of the shared folder, so that what is used more than once is made once."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):  # noqa: ANN202
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder on whatever file system it is."""
    fs, where = _file_system(spark, path)
    fs.delete(where, True)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes a small file on whatever file system it is."""
    fs, where = _file_system(spark, path)
    out = fs.create(where, True)
    out.write(bytearray(data))
    out.close()


def mounted_dir(spark: SparkSession) -> str:
    """A new, existing folder as a plain path, for readers that open files directly."""
    fs, where = _file_system(spark, shared_dir(spark))
    if fs.getUri().getScheme() != "file":
        raise ValueError("spark.checkpoint.dir is no mounted folder")
    fs.mkdirs(where)
    return where.toUri().getPath()


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the folders handed out within; results that read them must be written before."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            remove(spark, path)


def clear(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application; what reads them must be done."""
    remove(spark, shared_root(spark))
