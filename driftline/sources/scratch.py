"""Tables written to the folder that all executors share, to cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else (tests) a folder in the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return root or f"{spark.conf.get('spark.sql.warehouse.dir')}/.driftline-scratch"


def _place(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, path: str, only: str | None = None) -> list[str]:
    """Names in a folder, of `only` if given; none if there is no such folder."""
    at, fs = _place(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return [n for n in names if only is None or n == only]


def make_folder(spark: SparkSession, path: str) -> None:
    at, fs = _place(spark, path)
    fs.mkdirs(at)


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _place(spark, path)
    fs.delete(at, True)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone at exit
        remove(spark, path)


def written(df: DataFrame, tag: str) -> DataFrame:
    """`df` as a Parquet table that goes at exit."""
    spark, path = df.sparkSession, f"{scratch_root(df.sparkSession)}/driftline-core-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)
