"""Session helpers shared by the text operators."""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch() -> str:
    """A folder on the driver's own disk that goes when the driver ends."""
    folder = tempfile.mkdtemp(prefix="tideline-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a local session without that setting gets a folder of its own; on a cluster the setting is required,
    since a machine-local folder would hide one executor's files from the others.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not getattr(context, "_tideline_folder", None):
        context._tideline_folder = scratch()
    return "file://" + context._tideline_folder


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back; cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tideline/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._tideline_path = path
    for paths in _open:
        paths.append(path)
    return out


def discard(df: DataFrame) -> None:
    """Delete what save() wrote, once nothing reads it any more."""
    path = getattr(df, "_tideline_path", None)
    if path:
        _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of tables that nothing holds any more; it does so only when the driver's garbage
    is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


_open: list[list[str]] = []


@contextlib.contextmanager
def temporary(spark: SparkSession):
    """What the operators write to the shared folder inside the block is deleted at its end; write results before that."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            _delete(spark, path)


def place(names: list[str], name: str) -> int:
    """Where a column stands: the first of that very name, else the first that differs in case only."""
    if name in names:
        return names.index(name)
    return [n.lower() for n in names].index(name.lower())


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns (new name = source name), by position: other columns may repeat or clash in case."""
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"c{place(names, source)}").alias(new) for new, source in wanted.items()])


def filter_batches(df: DataFrame, keep) -> DataFrame:
    """df's rows, all columns unchanged, of which keep(batch, names) says True; keep gets an Arrow batch at a time."""
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches):
        for batch in batches:
            yield batch.filter(keep(batch, names))

    return plain.mapInArrow(run, plain.schema).toDF(*names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_sample(docs: DataFrame, rows: int, max_bytes: int, strata: str, most_labels: int = 10_000) -> list:
    """A bounded, deterministic sample (id, text, label): up to `rows` ids of each label, `max_bytes` of text in all, of the
    `most_labels` labels with the most ids (of as many, the first by name).

    docs has id, text and label (nulls in any are passed over). Ids are taken in the order of their hash, each once,
    however often it is repeated (of its texts the first in order counts). Only ids and lengths are ranked; texts are read
    for the chosen ids alone.
    """
    known = docs.where(F.col("id").isNotNull() & F.col("text").isNotNull() & F.col(strata).isNotNull())
    sized = known.groupBy("id", strata).agg(F.max(F.octet_length("text")).alias("n")).withColumn("h", F.xxhash64("id"))
    top = sized.groupBy(strata).agg(F.count("*").alias("ids")).orderBy(F.desc("ids"), strata).limit(most_labels).select(strata)
    rank = F.row_number().over(Window.partitionBy(strata).orderBy("h", "id"))
    ranked = sized.withColumn("rank", rank).where(F.col("rank") <= rows).join(F.broadcast(top), strata, "left_semi")
    chosen = ranked.collect()  # at most rows x most_labels ids and lengths
    chosen.sort(key=lambda r: (r["h"], r["id"]))
    total, ids = 0, {}
    for r in chosen:
        total += r["n"]
        if total > max_bytes and ids:
            break
        ids[r["id"]] = r[strata]
    if not ids:
        return []
    spark = docs.sparkSession
    few = spark.createDataFrame([(k,) for k in ids], known.select("id").schema)  # at most rows x labels ids
    one = known.join(F.broadcast(few), "id", "left_semi").groupBy("id").agg(F.min(F.struct("text", strata)).alias("first")).select("id", "first.*")
    return sorted(one.collect(), key=lambda r: r["id"])  # a row an id
