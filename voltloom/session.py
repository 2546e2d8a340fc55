"""Session settings and the shared work folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Inferring filters from fifty indicator columns takes the optimizer exponential time.
    "spark.sql.constraintPropagation.enabled": "false",
}
_local_dirs: dict[str, str] = {}
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the workers of the application once, so that they need no copy of their own."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return spark
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="voltloom-ship-")
    atexit.register(shutil.rmtree, folder, True)
    archive = os.path.join(folder, "voltloom_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for top, dirs, names in os.walk(package):
            dirs[:] = sorted(d for d in dirs if d != "__pycache__")
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(top, name)
                out.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the package and apply the runtime settings every operator relies on."""
    ship(spark)
    for key, value in _RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build(app: str = "voltloom", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def shared_root(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a scratch folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    app = sc.applicationId
    if app not in _local_dirs:
        path = tempfile.mkdtemp(prefix="voltloom-")
        atexit.register(shutil.rmtree, path, True)
        _local_dirs[app] = path
    return _local_dirs[app]


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def checkpoint(df):
    """Cut lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(f"{shared_root(spark)}/checkpoints")
    return df.checkpoint(eager=True)
