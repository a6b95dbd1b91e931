"""Getting the package to the Python workers, and the folder that all machines share."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()

#: Most bytes of an Arrow batch to a Python worker: long texts must not make a batch of many rows a large one.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application, so that Python workers can import it wherever the driver
    was started; no shared file system is needed. Arrow batches of the session are limited to ``BATCH_BYTES`` as well."""
    spark.conf.set(BATCH_KEY, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        root = Path(__file__).resolve().parent
        path = f"{tempfile.mkdtemp()}/feedloom.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        spark.sparkContext.addPyFile(path)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset a session on one machine (tests)
    takes one below the temp folder; a cluster has no folder to fall back on, so that is an error."""
    path, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not path and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path or f"{tempfile.gettempdir()}/checkpoints"


def scratch(spark: SparkSession) -> str:
    """This application's own folder below the shared one: delete it (``discard``) once all results are written."""
    return f"{shared_dir(spark)}/feedloom-{spark.sparkContext.applicationId}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage, whatever file system it is on."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
