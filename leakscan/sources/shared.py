"""Where jobs keep checkpoints and intermediate tables."""

from __future__ import annotations

import uuid
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster names; a session of one machine that names none has its warehouse."""
    root = spark.conf.get(SETTING, None)
    if root is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set {SETTING} to a folder all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return root.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def versioned_folder(spark: SparkSession, name: str, inputs: list[DataFrame]) -> str:
    """A folder that belongs to the files of the inputs: their names, sizes and times are in its name."""
    facts = []
    for path in sorted({p for df in inputs for p in df.inputFiles()}):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        status = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where)
        facts.append(f"{path} {status.getLen()} {status.getModificationTime()}")
    return f"{shared_root(spark)}/{name}-{sha256(chr(10).join(facts).encode()).hexdigest()}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a result that is read more than once, and read it back.

    For small results of costly scans; unlike a cached one, it outlives the
    executors that made it.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
