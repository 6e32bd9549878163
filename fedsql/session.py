"""Where jobs keep what all executors must be able to read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of applications that are deleted when they end.
_marked: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Where it is unset, a temporary one in local mode, as in tests; on a cluster, where executors would each write to
    their own disk, an error.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="fedsql-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)  # a folder of this application's own in there
        _goes_with(spark, sc.getCheckpointDir())
    return root


def _goes_with(spark: SparkSession, path: str) -> None:
    """Makes a folder that is deleted when the application ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)  # only what exists can be marked
    fs.deleteOnExit(at)


def shared_path(spark: SparkSession, name: str) -> str:
    """A name for a new folder in this application's part of :func:`shared_root`, which goes when the application ends, or with :func:`remove`."""
    own = f"{shared_root(spark).rstrip('/')}/fedsql/{spark.sparkContext.applicationId}"
    if own not in _marked:
        _goes_with(spark, own)
        _marked.add(own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession) -> None:
    """Deletes all tables that this application has kept in the shared folder so far; frames that read them end with it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for own in [x for x in _marked if x.endswith(spark.sparkContext.applicationId)]:
        at = jvm.org.apache.hadoop.fs.Path(own)
        at.getFileSystem(conf).delete(at, True)
        _marked.discard(own)


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
