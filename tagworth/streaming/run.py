"""Running a stream to its present end."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the shared one the cluster names in ``spark.checkpoint.dir``.

    Only a session on one machine, as in tests, may lack the setting; it then gets a
    temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="run-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def run_available(stream: DataFrame, path: str, output_mode: str = "append") -> DataFrame:
    """Process all available input, write it below ``path`` and return the result."""
    spark = stream.sparkSession
    query = (
        stream.writeStream.outputMode(output_mode)
        .format("parquet")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{path}/out")
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
