"""Tables between the rounds of an iteration, in the folder that all machines share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder_for(spark: SparkSession) -> str:
    """A new folder's name under spark.checkpoint.dir. Where that is unset on a local master (tests), a temporary folder is set."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", None) or ""):
            raise ValueError("spark.checkpoint.dir names no folder that all machines share")
        top = tempfile.mkdtemp(prefix="tracery-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/stage-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Writes the rows as Parquet to the shared folder and reads them again."""
    path = folder_for(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
