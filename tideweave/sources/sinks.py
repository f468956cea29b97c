"""Where results go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def write_text(df: DataFrame, path: str, **options) -> None:
    """CSV files; refuses to overwrite."""
    df.write.mode("errorifexists").options(**options).csv(path)


def discard(df: DataFrame) -> None:
    """Runs the whole plan and keeps nothing."""
    df.write.format("noop").mode("overwrite").save()


def write_stream(df: DataFrame, path: str, checkpoint: str, form: str = "parquet"):
    """Runs a streaming query over what there is now, into files."""
    return df.writeStream.format(form).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def scratch(spark: SparkSession) -> str:
    """A new folder's path in the shared one, spark.checkpoint.dir; without that, a temporary folder in local mode only."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(shared or tempfile.mkdtemp(prefix='tideweave-')).rstrip('/')}/tideweave-{uuid.uuid4().hex}"


def once(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: queries that read it twice, or several queries, run what is before it once."""
    path = f"{scratch(df.sparkSession)}/once"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
