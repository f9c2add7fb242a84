"""Tables computed once and kept where every executor can read them, for as long as something needs them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.cleaner.referenceTracking.cleanCheckpoints"
_OWN: dict[str, str] = {}
_MARKED: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. On one machine, as in tests, a temporary one where it is unset;
    on a cluster that would be the driver's own disk, so it is refused there."""
    if named := spark.conf.get("spark.checkpoint.dir", ""):
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="quillspark-")
        remove_at_exit(spark, _OWN[sc.applicationId])
    return _OWN[sc.applicationId]


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Removes a folder when the driver ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one, removed when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    remove_at_exit(spark, path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's shared checkpoint folder, its lineage cut.

    Its files go once nothing refers to it any more, unless the session says otherwise, and all when the driver ends.
    """
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    inner = sc._jsc.sc()
    if inner.getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
    if (own := inner.getCheckpointDir().get()) not in _MARKED:
        _MARKED.add(own)
        remove_at_exit(spark, own)
        if not inner.conf().contains(_CLEAN):
            inner.conf().set(_CLEAN, "true")
    return df.checkpoint()
