"""Tables written to the shared folder, to cut lineage and to read an expensive stage once.

A table written there survives the loss of any executor, which a cached or locally checkpointed
one does not. The folder is the one the cluster names in ``spark.checkpoint.dir``; only a session on a
local master without that setting, as in tests, gets a temporary folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if master not in _OWN:
        _OWN[master] = tempfile.mkdtemp(prefix="routinelens-")
    return _OWN[master]


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses; it goes when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tables/{label}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, with the same schema."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
