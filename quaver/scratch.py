"""Tables in the folder that driver and executors share, which cut the lineage of iterative operators."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` if set; else a temporary folder for a local master, or one in the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_quaver_tables"
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="quaver-tables-")
    return _local[app]


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/catalog/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(spark: SparkSession, source: str, name: str, build: Callable[[str], object]) -> str:
    """The folder of what ``build(folder)`` derives from the table at ``source``; built once per application and state of the table.

    A state is the bytes, files and last change of the table. A folder counts only after its build has ended.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    held, status = fs.getContentSummary(path), fs.getFileStatus(path)
    state = f"{source}|{held.getLength()}|{held.getFileCount()}|{status.getModificationTime()}"
    folder = f"{shared_folder(spark)}/stored/{spark.sparkContext.applicationId}/{name}-{hashlib.sha256(state.encode()).hexdigest()[:24]}"
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    into = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not into.exists(target):
        own = f"{folder}.{uuid.uuid4().hex}"
        build(own)
        if not into.rename(spark._jvm.org.apache.hadoop.fs.Path(own), target) and not into.exists(target):
            raise OSError(f"{folder} could not be published")
    return folder
