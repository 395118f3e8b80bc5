"""The shared folder of a cluster, and cutting lineage through it."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_LIVE: dict[str, DataFrame] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the session names none and all its executors are threads of this process, a temporary folder is made once and
    entered in the session's configuration; it is removed when Python ends. On a cluster a missing setting raises, since
    executors could not read what others wrote to their own disks.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder; on a cluster it must be one that all executors share")
        made = tempfile.mkdtemp(prefix="vellum-")
        atexit.register(shutil.rmtree, made, True)
        path = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def materialize(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder, in a folder for each value of ``partition_by`` if given, and return a scan of it.

    Used where a frame is read more than once or its lineage must end: the written files
    outlive executors, which a cached or locally checkpointed block does not. They last until ``release``, the end of a ``scope``
    or that of the application.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._written_to = path
    _LIVE[path] = made
    return made


def new_folder(spark: SparkSession) -> str:
    """A name for a folder in the shared folder, for files other than tables; deleted as those are."""
    path = f"{shared_dir(spark)}/vellum-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    made = spark.range(0)
    made._written_to = path
    _LIVE[path] = made
    return path


def materialize_counted(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """As ``materialize``, with aggregates over the rows taken while they are written, so that no second job counts them."""
    seen = Observation()
    made = materialize(df.observe(seen, *(c.alias(name) for name, c in counts.items())))
    return made, {name: value or 0 for name, value in seen.get.items()}


def release(*frames: DataFrame) -> None:
    """Delete the files behind frames made by ``materialize``, once nothing will read them; other frames are passed over."""
    for df in frames:
        folder = getattr(df, "_written_to", None)
        if folder and _LIVE.pop(folder, None) is not None:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scope() -> Iterator[None]:
    """All tables made within are deleted at its end, so results that read them must be written or collected before."""
    before = set(_LIVE)
    try:
        yield
    finally:
        release(*(df for path, df in list(_LIVE.items()) if path not in before))
