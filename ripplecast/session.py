"""Session settings the library relies on, and the folder it may write to."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """All wall-clock columns are UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


@functools.cache
def _own_root() -> str:
    """The one folder of this process for a local session without a setting; removed at its end."""
    root = tempfile.mkdtemp(prefix="ripplecast-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def _shared_root(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return _own_root()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path of its own under the cluster's shared folder, not yet created."""
    return f"{_shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows, written to the shared folder as Parquet and read back, so that columns can be pruned."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive the loss of any executor."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_shared_root(df.sparkSession))
    return df.checkpoint(eager=True)
