"""Tables in the shared folder that cut lineage, and Arrow batches of bounded size."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

#: Bytes of an Arrow batch where the session sets no limit: 10,000 rows of long texts take hundreds of MB on both sides.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = str(4 << 20)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Where none is set, a temporary one in local mode; executors of a cluster
    couldn't read the driver's, so there it is an error."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        got = tempfile.mkdtemp(prefix="tideweave-")
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: later jobs don't recompute it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tideweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _freed(run):
    """`run` for a worker that lives on: at a task's end the memory that its arrays left free goes back to the system."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return task


def map_arrow(df: DataFrame, run, schema: str | StructType) -> DataFrame:
    """df.mapInArrow(run, schema), in batches of BATCH_BYTES unless the session has a limit of its own. Spark takes a
    point in a column's name for a field's, so such columns have other names while they pass through `run`."""
    run = _freed(run)
    if df.sparkSession.conf.get(BATCH, None) is None:
        df.sparkSession.conf.set(BATCH, BATCH_BYTES)
    stem = "_" * (1 + max(map(len, df.columns), default=0))
    other = {c: f"{stem}{i}" for i, c in enumerate(df.columns) if "." in c}
    if not other or isinstance(schema, str):
        return df.mapInArrow(run, schema)
    safe = StructType([StructField(other.get(f.name, f.name), f.dataType, f.nullable) for f in schema])
    return df.toDF(*[other.get(c, c) for c in df.columns]).mapInArrow(run, safe).toDF(*schema.names)
