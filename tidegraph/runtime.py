"""Shared-folder materialisation: the one way this package cuts lineage.

Everything is written through Spark's own writers into the folder that the cluster names in
``spark.checkpoint.dir``, so a lost executor costs a recomputation and never a result.
"""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.lru_cache(maxsize=None)
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tidegraph-")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; in local mode without one a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return _own_dir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that Hadoop deletes when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tidegraph-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a frame made by :func:`materialize` that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tidegraph-" in top:
            where = jvm.org.apache.hadoop.fs.Path(top)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
