"""What the training-data operators share: reading tables, written intermediates, skew-safe lookups, distributed ranks."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of what counts as white space between words (Java and RE2 read it alike).
SPACES = r"[\x20\x09-\x0D]+"
#: Folders that this process has written intermediates to and not yet removed.
_LEFT: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a single machine (a local master, as in tests) gets a folder of its own; on a cluster that would be
    another folder on each machine, so it is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master or 'the cluster'} share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "veinstone-shared")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _LEFT.append(path)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here, and a lost executor costs no recomputation."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's file systems."""
    if path in _LEFT:
        _LEFT.remove(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def superseded(old: DataFrame) -> None:
    """Deletes the table that written() made of a loop's earlier state; nothing may read it any more."""
    for path in {file.rpartition("/")[0] for file in old.inputFiles()}:
        if own := next((left for left in _LEFT if left.split(":", 1)[-1].lstrip("/") == path.split(":", 1)[-1].lstrip("/")), None):
            remove(old.sparkSession, own)


@contextmanager
def intermediates_removed(spark: SparkSession) -> Iterator[None]:
    """Removes, at the end, what was written to the shared folder inside; results must have been written elsewhere by then."""
    before = set(_LEFT)
    yield
    for path in [path for path in _LEFT if path not in before]:
        remove(spark, path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc32(value: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes."""
    return F.crc32(value.cast("binary"))


#: A key is hot when it holds over 1/HOT_SHARE of the rows, so there are under HOT_SHARE hot keys.
HOT_SHARE = 512
SALTS = 64


def skew_safe_lookup(left: DataFrame, right: DataFrame, key: str, count: str, spread: Column) -> DataFrame:
    """Left join to a right side with one row per key; no task gets all rows of a frequent key.

    count: the right column with the number of left rows of that key. Keys over 1/HOT_SHARE of all rows
    (under HOT_SHARE of them, which bounds the broadcast) are copied SALTS times, and their left rows are
    dealt over the copies by ``spread``, an integer-hashable column. The other keys are joined by shuffle.
    A null key matches nothing.
    """
    total = right.agg(F.sum(count).alias("n")).first()["n"] or 0
    is_hot = F.col(count) > F.lit(max(1.0, total / HOT_SHARE))
    hot = right.where(is_hot).select(F.col(key), F.lit(True).alias("_hot"))
    left = left.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.hash(spread), F.lit(SALTS))).otherwise(F.lit(0))
    )
    right = right.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "_salt"], "left").drop("_salt", "_hot")
