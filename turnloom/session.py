"""Session settings and the one way of cutting lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Settings for a stand-alone run; a cluster's own settings win where the session already exists.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A session for tests and the bench on one machine."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("turnloom")
    for key, value in {**DEFAULTS, "spark.sql.shuffle.partitions": "8", "spark.driver.memory": memory, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written to the reliable checkpoint folder and read back.

    Iterative operators call this once a round, so that a lost executor costs a re-read and
    the plan doesn't double each round. The folder is spark.checkpoint.dir; only where that is
    unset (tests on one machine) a temporary one is made.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or _temporary())
    return df.checkpoint(eager=True).hint("merge")


def _temporary() -> str:
    """A folder of this machine that goes with the process."""
    folder = tempfile.mkdtemp(prefix="turnloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, where their path may not have it.

    Nothing is sent if the package's folder is on PYTHONPATH or is the working folder, which workers share.
    """
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    shared = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    context = spark.sparkContext
    if any(p and os.path.abspath(p) == root for p in shared) or getattr(context, "_turnloom_sent", False):
        return
    path = os.path.join(_temporary(), "turnloom.zip")  # the driver serves the file for as long as it lives
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in os.walk(package):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(at, n), os.path.relpath(os.path.join(at, n), root))
    context.addPyFile(path)
    context._turnloom_sent = True
