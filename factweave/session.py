"""Session settings and the shared folder for checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "factweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; on a cluster pass no master."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        # a checkpoint goes when nothing refers to it any more
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _delete_at_exit(spark: SparkSession, folder: str) -> None:
    """Have the driver's JVM delete a folder when it ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The application's folder for checkpoints: within the cluster's spark.checkpoint.dir, else one of our own.

    A machine-local folder is only ever made where the session names none and runs in local mode; on a
    cluster without the setting this raises. That the folder named is shared is the cluster's to see to.
    A folder made here is deleted when the driver ends; one that the session has already set is left to it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        if not named:
            named = tempfile.mkdtemp(prefix="factweave-checkpoint-")
            _delete_at_exit(spark, named)
        sc.setCheckpointDir(named)
        current = sc._jsc.sc().getCheckpointDir()
        _delete_at_exit(spark, current.get())
    return current.get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a written table, deleted when the driver ends."""
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _delete_at_exit(spark, path)
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut df's lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application.

    Workers inherit neither the driver's sys.path nor its folder, so the package goes to them as a zip file
    over Spark's own file server.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    home = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="factweave-code-")
    _delete_at_exit(spark, f"file://{folder}")
    path = os.path.join(folder, "factweave.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(home):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("factweave", os.path.relpath(full, home)))
    sc.addPyFile(path)


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The parquet table NAME of a data directory."""
    return spark.read.parquet(os.path.join(directory, f"{name}.parquet"))
