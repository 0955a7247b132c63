"""Session construction and small helpers shared by the query plans."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession


def build_session(cores: int | None = None, app: str = "termloom") -> SparkSession:
    """A session for this machine. What spark-submit, spark-defaults or the environment set stays as it is: values are
    given only where none is set."""
    n = cores or os.cpu_count() or 4
    given = SparkConf()
    wanted = {
        "spark.master": f"local[{n}]",
        "spark.app.name": app,
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
    }
    if given.contains("spark.master") and not given.get("spark.master").startswith("local"):
        wanted = {k: wanted[k] for k in ("spark.app.name", "spark.sql.session.timeZone")}
    builder = SparkSession.builder
    for k, v in wanted.items():
        if not given.contains(k):
            builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. A temporary one stands in only where all
    tasks run in this process; on a cluster its lack is an error, as a machine's own folder would lose data."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="termloom-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: its past ends there, is computed once, and survives lost
    executors."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
