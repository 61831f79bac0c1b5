"""Session helper. On a cluster the submitter's settings win over these defaults."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def local_session(cores: int | str = "*", app: str = "recalloom", **conf: str) -> SparkSession:
    """A local session for tests and benches; keyword dots are written as ``__``."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **_DEFAULTS,
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def session(app: str = "recalloom") -> SparkSession:
    """The session of the command line: the submitter's where one submits, else a local one."""
    if SparkSession.getActiveSession() is not None:
        return ship(SparkSession.getActiveSession())
    if "PYSPARK_GATEWAY_PORT" not in os.environ:
        return local_session(app=app)
    # Started by spark-submit, which has settled master, memory and partitions.
    spark = SparkSession.builder.appName(app).getOrCreate()
    for key, value in _DEFAULTS.items():
        if not spark.sparkContext.getConf().contains(key):
            spark.conf.set(key, value)
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application.

    Functions that run in Python tasks are looked up there by name. Where the package is
    installed or passed with ``--py-files`` already, this changes nothing.
    """
    sc = spark.sparkContext
    if getattr(sc, "_recalloom_shipped", None) is None:
        package = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="recalloom-"), "recalloom.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for folder, _, files in os.walk(package):
                for name in sorted(f for f in files if f.endswith(".py")):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("recalloom", os.path.relpath(path, package)))
        sc.addPyFile(archive)
        sc._recalloom_shipped = archive
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the session.

    A cluster must name a shared folder in ``spark.checkpoint.dir``. Only a local
    session without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="recalloom-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named
