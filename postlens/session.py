"""Session set-up and the shared staging area."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  memory: str = "8g") -> SparkSession:
    """Session for tests and the local bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("postlens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.postlens.spread", str(cores if str(cores).isdigit() else shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@lru_cache(maxsize=None)
def _local_folder(app_id: str) -> str:
    return tempfile.mkdtemp(prefix="postlens-")


def staging_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only in local mode without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return _local_folder(context.applicationId)


_STAGED: dict[str, list[str]] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the staging area, which `drop_staged` removes; made by who writes to it."""
    path = f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the staging area and read it back.

    Used where several later passes read the same costly result: the written table survives lost
    executors, and being columnar each pass reads only the columns it needs. `drop_staged` removes
    what a session has staged.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _located(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_note(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole or not at all, in any store that Spark reaches; it replaces an older one."""
    store, at = _located(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = store.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    store.delete(at, False)
    if not store.rename(part, at):
        raise OSError(f"could not write {path}")


def read_note(spark: SparkSession, path: str) -> str:
    store, at = _located(spark, path)
    file = store.open(at)
    try:
        return bytes(file.readAllBytes()).decode()
    finally:
        file.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it is not there."""
    store, at = _located(spark, path)
    return sorted(f.getPath().getName() for f in store.listStatus(at)) if store.exists(at) else []


def files_under(spark: SparkSession, path: str) -> dict[str, int]:
    """Paths and bytes of all files under a folder (or of the one file); files and folders whose names
    start with `_` or `.` are left out, as Spark's readers do."""
    store, at = _located(spark, path)
    if not store.exists(at):
        return {}
    found, base = {}, at.toUri().getPath().rstrip("/")
    each = store.listFiles(at, True)
    while each.hasNext():
        file = each.next()
        inner = file.getPath().toUri().getPath()[len(base):]
        if not any(part.startswith(("_", ".")) for part in inner.split("/")):
            found[file.getPath().toString()] = file.getLen()
    return found


def remove(spark: SparkSession, path: str) -> None:
    store, at = _located(spark, path)
    store.delete(at, True)


def drop_staged(spark: SparkSession) -> int:
    """Remove the staged tables and folders of this application, once its results are written; returns
    how many.

    Results that were not written yet can no longer be read afterwards.
    """
    paths = _STAGED.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        remove(spark, path)
    return len(paths)


#: Tasks for each core where a few small files make much work.
TASKS_A_CORE = 4


def spread(scan: DataFrame) -> DataFrame:
    """Deal a scan's rows over as many tasks as `spark.postlens.spread` says, if the session sets it.

    One parquet row group or one JSON array is one task, however long its texts. A session over a few
    small files, such as the local one, asks for it; a cluster sets the split size at the reader
    (`spark.sql.files.maxPartitionBytes`) and moves nothing.
    """
    tasks = scan.sparkSession.conf.get("spark.postlens.spread", None)
    return scan.repartition(int(tasks)) if tasks else scan


def spread_small(scan: DataFrame, *by: str) -> DataFrame:
    """Deal rows that are short themselves but make long work over all cores; rows equal in `by`, if named,
    to one task.

    A row group of a million short rows is a few MB, so no split size at the reader parts it, and all
    that is derived from them would be one task's. Unlike `spread` it needs no setting: what moves is
    small. `spark.postlens.spread` holds here too.
    """
    spark = scan.sparkSession
    tasks = spark.conf.get("spark.postlens.spread", None) or TASKS_A_CORE * spark.sparkContext.defaultParallelism
    return scan.repartition(int(tasks), *by)
