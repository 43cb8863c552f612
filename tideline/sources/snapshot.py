"""Consistent snapshots: a pinned copy of tables and the log position that it is consistent with."""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.streaming.cdc import lsn_number, parse_lsn


@dataclass(frozen=True)
class Export:
    """A snapshot's name and folder, and the position after which changes are not in it."""

    name: str
    path: str
    consistent_lsn: str


def export(spark: SparkSession, folder: str, tables: dict[str, DataFrame], consistent_lsn: str, prefix: str = "snapshot") -> Export:
    """Write tables once, under a name of their own, beside a note of the position."""
    parse_lsn(consistent_lsn)
    made = Export(f"{prefix}_{uuid.uuid4().hex[:12]}", folder.rstrip("/"), consistent_lsn)
    for name, df in tables.items():
        df.write.parquet(f"{made.path}/{made.name}/{name}")
    spark.createDataFrame([(made.name, consistent_lsn, json.dumps(sorted(tables)))], "name string, consistent_lsn string, tables string").coalesce(1).write.parquet(f"{made.path}/{made.name}/_note")
    return made


def load(spark: SparkSession, folder: str, name: str) -> tuple[Export, dict[str, DataFrame]]:
    """A snapshot by its name; readers see the same rows however often they read."""
    if not name.replace("_", "").isalnum():
        raise ValueError(f"not a snapshot's name: {name!r}")
    folder = folder.rstrip("/")
    note = spark.read.parquet(f"{folder}/{name}/_note").first()
    return Export(name, folder, note["consistent_lsn"]), {t: spark.read.parquet(f"{folder}/{name}/{t}") for t in json.loads(note["tables"])}


def drop(spark: SparkSession, made: Export) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{made.path}/{made.name}")
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextlib.contextmanager
def exported(spark: SparkSession, folder: str, tables: dict[str, DataFrame], consistent_lsn: str) -> Iterator[Export]:
    """A snapshot for as long as the block runs."""
    made = export(spark, folder, tables, consistent_lsn)
    try:
        yield made
    finally:
        drop(spark, made)


def after(changes: DataFrame, made: Export) -> DataFrame:
    """The changes that the snapshot does not hold."""
    return changes.where(lsn_number(F.col("commit_lsn")) > F.lit(str(parse_lsn(made.consistent_lsn))).cast("decimal(20,0)"))
