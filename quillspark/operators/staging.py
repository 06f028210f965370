"""Tables written to the folder that all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, what: str = "quillspark") -> str:
    """A new path in the shared folder; in a temporary one only where none is set and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(base or tempfile.gettempdir()).rstrip('/')}/{what}/{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write a table and read it back: what several steps read is computed once, and stays the same for each."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
