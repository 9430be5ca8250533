"""Tables by name, and places for what is made of them."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from veinstone.operators.tables import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept_at(spark: SparkSession, sf_dir: str, *names: str) -> str:
    """A folder in the shared one for what is made of some tables: the same one while their files are the same."""
    said, conf = [], spark.sparkContext._jsc.hadoopConfiguration()
    for file in sorted(file for name in names for file in table(spark, sf_dir, name).inputFiles()):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
        status = path.getFileSystem(conf).getFileStatus(path)
        said.append(f"{file} {status.getLen()} {status.getModificationTime()}")
    return f"{shared_folder(spark)}/{'-'.join(names)}-index-{hashlib.sha256('|'.join(said).encode()).hexdigest()[:24]}"
