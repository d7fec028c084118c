"""Where queries write files that they read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new folder below the cluster's spark.checkpoint.dir; below one of our own only where none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="shelfwise-"))
        root = _own[0]
    return f"{root.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, batch: int | None = None) -> DataFrame:
    """``df`` written once as Parquet and read back; what was shuffled for it goes at once, the files go with ``dropped``, or when Spark ends.

    Python gets ``batch`` rows at a time, where that is given.
    """
    path, conf = scratch(df.sparkSession), df.sparkSession.conf
    own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | ({"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch)} if batch else {})
    before = {k: conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    where, store = _place(df.sparkSession, path)
    store.deleteOnExit(where)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def dropped(table: DataFrame) -> None:
    """Delete the files of a table of ``written``."""
    where, store = _place(table.sparkSession, table._scratch)
    store.delete(where, True)
