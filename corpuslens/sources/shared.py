"""The folder that all executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application's in the one that spark.checkpoint.dir names. Where the session names none, one of the warehouse if
    all runs on one machine, else an error: executors of a cluster don't see each other's local folders. An application's tables lie
    under its id, so that they can be removed with it."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        place = spark.conf.get("spark.sql.warehouse.dir") + "/_shared"
    return f"{place.rstrip('/')}/{spark.sparkContext.applicationId}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut, and lost executors lose nothing of it."""
    path = f"{shared_dir(df.sparkSession)}/steps/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows and bytes: texts may be long, and each worker holds a batch or two."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
