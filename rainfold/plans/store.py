"""Reading tables and cutting lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only on one machine, as in tests, a temporary one stands in where none is set."""
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir")
    if known is None and sc._jsc.sc().getCheckpointDir().isDefined():
        known = sc._jsc.sc().getCheckpointDir().get()
    if known is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        known = tempfile.mkdtemp(prefix="rainfold-")
        sc.setCheckpointDir(known)
    return known


def new_path(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that nothing else has."""
    return os.path.join(shared_folder(spark), f"{kind}-{uuid.uuid4().hex}")


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table that `new_path` named and that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Narrow rows that a task of an iteration's small table holds at least.
TASK_ROWS = 100_000


def apart(df: DataFrame) -> DataFrame:
    """df as a side of a join that is shuffled whatever its files' size: written cells take a hundredth of the memory that a broadcast of them would."""
    return df.hint("merge")


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df as a table written to the shared folder and read again.

    Iterations keep a short plan, survive lost executors, and the planner goes by the table's true size, which a chain of
    checkpoints would estimate by multiplying the sizes of all joins before. With a bound on its number of rows a table gets
    no more tasks and files than they need; for narrow tables behind a shuffle.
    """
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // TASK_ROWS)))
    path = new_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
