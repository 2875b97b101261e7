"""Size checks and shared-storage tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# rows up to which a side may be broadcast, or a group may be handled by one task
SMALL_ROWS = 1_000_000
BROADCAST_ROWS = 100_000


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for written intermediate tables: the one the cluster names, if it names one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = named or spark.sparkContext.getCheckpointDir()
    if current:
        return current
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-"))
    return spark.sparkContext.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame once to shared storage and read it back.

    Later passes read a pruned columnar table instead of repeating joins and shuffles, and a
    lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


HUGE_METHOD = 8000  # bytes of code up to which the JVM compiles a method


def materialize_wide(df: DataFrame) -> DataFrame:
    """``materialize`` for rows of many computed columns.

    The code of a whole stage is one method, which the JVM only interprets beyond a length that
    some dozens of expressions reach; during this write such stages run as small methods instead.
    """
    spark = df.sparkSession
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(HUGE_METHOD))
    try:
        return materialize(df)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def discard(df: DataFrame) -> None:
    """Remove the table behind a frame that ``materialize`` returned; nothing may read it later."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether a frame has no more rows than that; a long one is not read to its end."""
    return df.select().offset(rows).isEmpty()


def lookup_join(left: DataFrame, right: DataFrame, on, how: str = "left") -> DataFrame:
    """Join a lookup table, broadcasting it only if its row count allows.

    The check fetches one row more than may be broadcast.  Above the bound the join shuffles,
    and adaptive skew handling splits the hot keys of ``left``.
    """
    rows = right.limit(BROADCAST_ROWS + 1).collect()
    if len(rows) <= BROADCAST_ROWS:
        names = right.columns
        fixed = left.sparkSession.createDataFrame(rows, right.schema, verifySchema=False)
        right = F.broadcast(fixed.toDF(*names))
    return left.join(right, on, how)
