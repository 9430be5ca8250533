"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with over 1/HOT of the rows is dealt out over COPIES tasks.
HOT, COPIES = 512, 64
#: Folders that settled() has made in this process, which go when it ends.
_MADE: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a single machine (a local master) gets a folder where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master or 'the cluster'} share")
        folder = f"file://{tempfile.gettempdir()}/veinstone-tables"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def settled(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """df written and read again: iterations neither grow the lineage nor recompute it. The folder goes when the process ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    _MADE[path] = spark
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's file systems."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _swept() -> None:
    try:
        for path, spark in _MADE.items():
            if spark.sparkContext._jsc is None:  # stopped before: what is left is the folder's owner's to clear
                return
            deleted(spark, path)
    except (Py4JError, OSError):  # so is it where the JVM is gone
        return


def dropped(spark: SparkSession, tables: list[DataFrame]) -> None:
    """Deletes the folders of settled tables that nothing reads any more."""
    root = shared_folder(spark).split(":", 1)[-1].lstrip("/")
    for table in tables:
        for path in {file.rpartition("/")[0] for file in table.inputFiles()}:
            if path.split(":", 1)[-1].lstrip("/").startswith(root):
                deleted(spark, path)


def looked_up(left: DataFrame, right: DataFrame, key: str, rows: str, spread: Column) -> DataFrame:
    """Left join to a right side with one row for each key, of which no task gets all rows of a frequent one.

    rows: the column of the right side that tells how many rows of the key the left side has; it goes. Keys with over 1/HOT of all, of which there are under HOT,
    are copied, and their left rows dealt over the copies by ``spread``. A null key finds nothing.
    """
    total = right.agg(F.sum(rows).alias("n")).first()["n"] or 0
    often = F.col(rows) > F.lit(max(1.0, total / HOT))
    hot = F.broadcast(right.where(often).select(F.col(key).alias("_hot")))
    dealt = left.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_copy", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(COPIES)).cast("int")).otherwise(0)).drop("_hot")
    copied = right.withColumn("_copy", F.explode(F.when(often, F.sequence(F.lit(0), F.lit(COPIES - 1))).otherwise(F.array(F.lit(0))))).drop(rows)
    return dealt.join(copied, [key, "_copy"], "left").drop("_copy")
