"""Session defaults for running outside a configured cluster."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def let_workers_import(spark: SparkSession) -> SparkSession:
    """Put this package's folder on the import path of Python workers, for sessions that were started elsewhere.

    The folder must be readable by executors at the same path; where it isn't, the package goes to them by ``--py-files``.
    """
    root = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return spark


def local_session(cores: int | str = 8, app: str = "vellum") -> SparkSession:
    """A local session with the settings the command line and the bench use. Intermediate tables go to ``VELLUM_SHARED_DIR``, else to a folder that lasts as long as Python."""
    shared = os.environ.get("VELLUM_SHARED_DIR")
    if not shared:
        shared = tempfile.mkdtemp(prefix="vellum-")
        atexit.register(shutil.rmtree, shared, True)
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", Path(shared).resolve().as_uri())
        .config("spark.driver.memory", os.environ.get("VELLUM_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    return let_workers_import(session)
