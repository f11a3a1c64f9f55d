"""Tables in the folder that all executors share, by which lineage is cut."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir. Where it is unset, a new local one in local mode (tests), and an
    error on a cluster, whose executors would not see it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="folioq-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write `df` as Parquet in the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
