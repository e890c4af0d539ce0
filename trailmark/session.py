"""Session helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_own_dirs: dict[str, str] = {}


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("trailmark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="trailmark-")
        atexit.register(shutil.rmtree, _own_dirs[app], True)
    return _own_dirs[app]


def durable(spark: SparkSession, folder: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """Writes tables below a folder (of the shared one, if none is given) and reads them
    back, so that neither lost executors nor later steps compute them again."""
    base = folder or f"{shared_dir(spark)}/trailmark/{uuid.uuid4().hex}"
    done: list[str] = []

    def keep(rows: DataFrame) -> DataFrame:
        done.append(f"{base}/{len(done)}")
        rows.write.mode("overwrite").option("compression", "zstd").parquet(done[-1])
        return rows.sparkSession.read.schema(rows.schema).parquet(done[-1])

    return keep


def bound_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, so that very long texts fit a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python, through Spark's own
    file distribution; once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="trailmark-", suffix=".zip")
    with os.fdopen(fd, "wb") as file, zipfile.ZipFile(file, "w") as archive:
        for folder, _, names in sorted(os.walk(here)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.join("trailmark", os.path.relpath(full, here)))
    spark.sparkContext.addPyFile(path)
    atexit.register(lambda: os.path.exists(path) and os.remove(path))
    _shipped.add(app)
