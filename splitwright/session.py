"""Session settings and the shared scratch area that long jobs cut their lineage with."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from itertools import count
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings every plan in the library assumes; sizes are left to the deployment.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A single-process session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("splitwright")
    conf = SETTINGS | {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.driver.memory": memory,
        "spark.driver.host": "127.0.0.1",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | extra
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only when everything is one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or _own.get(spark.sparkContext.applicationId)
    if root:
        return root.rstrip("/")
    # local-cluster has several processes, as a cluster has
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    _own[spark.sparkContext.applicationId] = root = "file://" + tempfile.mkdtemp(prefix="splitwright-")
    return root


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable on all executors, once for each application.

    The code, a few hundred kilobytes, is zipped on the driver and handed to Spark, which copies it to the executors.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = Path(__file__).resolve().parent
    # Spark serves the file from where it lies, so it stays until the process ends
    folder = tempfile.mkdtemp(prefix="splitwright-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "splitwright.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


class Workspace:
    """Tables written under ``spark.checkpoint.dir``.

    An iterative operator writes each round as a table and reads it back. That cuts the lineage,
    gives the optimizer real sizes, and leaves nothing on an executor that could be lost with it.
    """

    def __init__(self, spark: SparkSession, label: str):
        ship(spark)
        self.spark = spark
        self.base = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self._next = count()  # several threads may keep tables
        atexit.register(self._remove, self.base)

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{next(self._next):04d}"
        df.write.mode("overwrite").parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._splitwright_path = path
        return kept

    def __enter__(self) -> "Workspace":
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        """Removes all tables; frames read from them can't be used after that."""
        self._remove(self.base)

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_splitwright_path", None)
        if path:
            self._remove(path)

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may be gone at exit; the folder is scratch
            pass
