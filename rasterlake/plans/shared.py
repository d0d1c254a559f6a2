"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A folder of this name in spark.checkpoint.dir. Only a session on one machine may go without that setting (it gets an own folder then); on a cluster its absence is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="rasterlake-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{tag}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet and read again: what is used more than once is made once, and a lost executor costs no recomputation."""
    path = shared_folder(df.sparkSession, f"rasterlake/{tag}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
