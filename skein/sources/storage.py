"""The folder that driver and executors share, and tables written there to end a lineage."""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import time
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a local one is set here only in local mode, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
        at = spark.sparkContext.getCheckpointDir()
    return at


_written: list[str] = []


@atexit.register
def forget() -> None:
    """Deletes what ``cut`` has written, when the driver's program ends in order."""
    context = SparkContext._active_spark_context
    if context is None or context._jsc is None:
        return
    with contextlib.suppress(Exception):  # the session may be ending already
        for path in _written:
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
    _written.clear()


def cut(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again.

    A lost executor costs no recomputation beyond this point. With ``release``
    the driver looks at once for shuffle files that nothing refers to any more,
    so that large ones are off the disks before the next stage writes its own.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    del df
    for _ in range(2 * release):  # the first frees Python's references, the second what those held in the JVM
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
    return spark.read.schema(schema).parquet(path)
