"""Folders for streams, and a stream run to its end as a table."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; only a local session without that setting uses a temporary folder."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tideline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = "file://" + folder
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, so that its plan ends there."""
    path, schema = shared_folder(df.sparkSession, name), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def complete_table(spark: SparkSession, path: str, schema, plan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A plan over a folder of Parquet files (or one file) read as a stream, run until all is read; its result table.

    The result is written by foreachBatch in complete mode, each batch in place of the one before."""
    root = shared_folder(spark, "complete")
    folder, _, file = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema)
    source = reader.option("pathGlobFilter", file).parquet(folder) if _is_file(spark, path) else reader.parquet(path)
    last = {}

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/v{batch_id}")
        last["id"] = batch_id

    query = plan(source).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{root}/v{last['id']}")


def _is_file(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(target).isFile()
