"""Tables written to the folder that all executors share.

Lineage is cut by writing a Parquet table: it is computed once, committed by
Spark's own protocol, and can be read again after any executor is lost.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
_tables: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset a temporary folder is used, but only with a local master:
    on a cluster a machine-local folder would be invisible to other machines.
    """
    global _own_dir
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_dir is None:
        folder = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own_dir = "file://" + folder
    return _own_dir


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, with the scheme of its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString()


def keep_path(path: str) -> str:
    """Note a folder that an operator writes itself, so that :func:`clean` deletes it."""
    _tables.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return it as read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    _tables.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def discard(df: DataFrame | None) -> None:
    """Delete a table of :func:`materialize` that nothing reads any more."""
    if path := getattr(df, "_tessera_path", None):
        _delete(df.sparkSession, path)
        _tables.remove(path)


def clean(spark: SparkSession) -> None:
    """Delete all tables that this process has written and not discarded; results that still read them become unusable."""
    while _tables:
        _delete(spark, _tables.pop())
