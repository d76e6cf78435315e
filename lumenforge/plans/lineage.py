"""Cut lineage with tables that every executor can read again after another executor is lost."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIR = "/tmp/checkpoints/lumenforge"
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a folder of our own, but only if driver and executors are one process: on a
    cluster each machine would write to its own disk, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or _LOCAL_DIR).rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and return a scan of it.

    An empty ``df`` keeps its schema. The files stay until ``discard`` or until the driver ends, as
    later actions read them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumenforge/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``materialize`` returned and that no later plan reads any more."""
    for df in tables:
        path = getattr(df, "_shared_path", None)
        if path in _written:
            _delete(_written.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def release() -> None:
    """Delete every table that ``materialize`` wrote in this process."""
    while _written:
        path, spark = _written.popitem()
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone already
            return
