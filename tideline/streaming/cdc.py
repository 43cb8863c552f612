"""Change streams: transactions of row changes by commit position, applied to tables.

A change has commit_lsn (`X/Y` in hex), seq (its place in the transaction), table_name, operation (insert, update,
delete), commit_time, keys, old and new (JSON objects). A column that new lacks is unchanged, which is not the same as
null. Order is (lsn, seq); positions are 64-bit unsigned and so kept as decimal(20,0).
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHANGES = "commit_lsn string, seq int, table_name string, operation string, commit_time timestamp, keys string, old string, new string"


def lsn_number(lsn: Column) -> Column:
    """An `X/Y` position as decimal(20,0); an empty or null one is 0, a malformed one null."""
    pattern = "^([0-9A-Fa-f]{1,8})/([0-9A-Fa-f]{1,8})$"
    half = lambda k: F.conv(F.regexp_extract(lsn, pattern, k), 16, 10).cast("decimal(20,0)")
    good = (half(1) * F.lit(1 << 32).cast("decimal(20,0)") + half(2)).cast("decimal(20,0)")
    return F.when(F.coalesce(lsn, F.lit("")) == "", F.lit(0).cast("decimal(20,0)")).when(lsn.rlike(pattern), good)


def lsn_compare(a: Column, b: Column) -> Column:
    x, y = lsn_number(a), lsn_number(b)
    return F.when(x < y, -1).when(x > y, 1).when(x == y, 0)


def lsn_distance(a: Column, b: Column) -> Column:
    """How far b lies behind a; 0 if it doesn't."""
    return F.greatest(lsn_number(a) - lsn_number(b), F.lit(0).cast("decimal(20,0)")).cast("decimal(20,0)")


def parse_lsn(text: str) -> int:
    """The same on the driver; ValueError for malformed text."""
    if not text:
        return 0
    high, slash, low = text.partition("/")
    if not slash or not 0 < len(high) <= 8 or not 0 < len(low) <= 8:
        raise ValueError(f"not a log position: {text!r}")
    return int(high, 16) << 32 | int(low, 16)


def format_lsn(number: int) -> str:
    return f"{number >> 32:X}/{number & 0xFFFFFFFF:X}"


#: Types of decoded values by PostgreSQL's type number; any other is text.
TYPES_BY_OID = {20: "bigint", 21: "bigint", 23: "bigint", 1700: "decimal(38,10)", 700: "double", 701: "double", 16: "boolean"}


def decode_value(text: Column, oid: Column) -> Column:
    """A text value in the canonical text of its type number's type; one that doesn't parse stays as it is."""
    out = text
    for number, kind in TYPES_BY_OID.items():
        value = F.when(text == "t", True).when(text == "f", False) if kind == "boolean" else text.try_cast(kind)
        out = F.when(oid == number, F.coalesce(value.cast("string"), text)).otherwise(out)
    return out


#: A decoded log's rows: what happened (I, U, D), and each tuple's columns; kind: n null, u unchanged (not sent), t text.
TUPLE = "array<struct<name:string, is_key:boolean, oid:int, kind:string, text:string>>"
MESSAGES = f"commit_lsn string, seq int, table_name string, action string, commit_time timestamp, old {TUPLE}, new {TUPLE}"


def tuple_values(columns: Column) -> Column:
    """A tuple's values by name: null for n, nothing at all for u, else the text in its type's canonical form."""
    sent = F.filter(columns, lambda c: c["kind"] != "u")
    return F.map_from_entries(F.transform(sent, lambda c: F.struct(c["name"], F.when(c["kind"] != "n", decode_value(c["text"], c["oid"])))))


def decoded(messages: DataFrame) -> DataFrame:
    """CHANGES of MESSAGES: inserts, updates and deletes; other actions (truncate, type, origin) are passed over. Keys are
    the columns flagged so: of the new tuple, for a delete of the old one."""
    names = {"I": "insert", "U": "update", "D": "delete"}
    operation = F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col("action"))
    text = lambda c: F.when(c.isNotNull(), F.to_json(tuple_values(c), {"ignoreNullFields": "false"}))
    flagged = F.filter(F.when(F.col("action") == "D", F.col("old")).otherwise(F.col("new")), lambda c: c["is_key"])
    rows = messages.where(F.col("action").isin(*names))
    return rows.select("commit_lsn", "seq", "table_name", operation.alias("operation"), "commit_time", text(flagged).alias("keys"), text(F.col("old")).alias("old"), F.when(F.col("action") != "D", text(F.col("new"))).alias("new"))


def transactions(changes: DataFrame) -> DataFrame:
    """One row a transaction: commit_lsn, lsn, commit_time, number of changes, of each operation, tables touched."""
    kinds = [F.count_if(F.col("operation") == k).alias(f"{k}s") for k in ("insert", "update", "delete")]
    return changes.where(F.col("operation").isin("insert", "update", "delete")).groupBy("commit_lsn").agg(
        F.first(lsn_number(F.col("commit_lsn"))).alias("lsn"), F.max("commit_time").alias("commit_time"), F.count("*").alias("changes"), *kinds, F.array_sort(F.collect_set("table_name")).alias("tables")
    )


def limited(changes: DataFrame, most: int, policy: str = "block") -> DataFrame:
    """At most `most` changes of a transaction under the policy `drop`, which discards the later ones (and so cuts the
    transaction); block and merge, and any limit of 0 or less, keep all."""
    if policy != "drop" or most <= 0:
        return changes
    order = Window.partitionBy("commit_lsn").orderBy("seq")
    return changes.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def final_state(changes: DataFrame, key: str, columns: dict[str, str], base: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """The rows that a log leaves: key and columns (name to type) by the last change of each key.

    A column's value is the newest that a change names, unless the key was inserted or deleted after it. Both positions
    come out of one aggregation by key with map-side combining, so a key with very many changes is no hot spot. base: the
    rows before the log (a snapshot), older than any change. keys: names of all columns of a composite key, of which
    `key` is the first."""
    keys = keys or [key]
    order = F.struct(lsn_number(F.col("commit_lsn")).alias("lsn"), F.col("seq"))
    own = [f"_k{i}" for i in range(len(keys))]
    rows = changes.where(F.col("operation").isin("insert", "update", "delete")).select(*[F.get_json_object("keys", f"$.{k}").alias(o) for k, o in zip(keys, own)], "operation", order.alias("_at"), "new")
    if base is not None:
        at = F.struct(F.lit(-1).cast("decimal(20,0)").alias("lsn"), F.lit(0).alias("seq"))
        old = base.select(*[F.col(k).cast("string").alias(o) for k, o in zip(keys, own)], F.lit("insert").alias("operation"), at.alias("_at"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("new"))
        rows = old.unionByName(rows)
    named = {c: F.array_contains(F.coalesce(F.json_object_keys("new"), F.array().cast("array<string>")), c) for c in columns}
    values = [F.max_by(F.struct(F.get_json_object("new", f"$.{c}").alias("v"), F.col("_at").alias("at")), F.when(named[c], F.col("_at"))).alias(c) for c in columns]
    reset = F.max(F.when(F.col("operation") != "update", F.col("_at"))).alias("_reset")
    last = rows.groupBy(*own).agg(F.max_by("operation", "_at").alias("_last"), reset, *values)
    fresh = lambda c: F.when(F.col("_reset").isNull() | (F.col(f"{c}.at") >= F.col("_reset")), F.col(f"{c}.v"))
    kept = last.where("_last != 'delete'")
    return kept.select(*[F.col(o).alias(k) for k, o in zip(keys, own)], *[fresh(c).cast(t).alias(c) for c, t in columns.items()])


class Checkpoint:
    """The last position of each slot, kept as a table in a shared folder; a save never goes back.

    Each save writes a new small version beside the old ones; the newest readable version counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> DataFrame | None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(path):
            return None
        return self.spark.read.schema("slot_name string, last_lsn string, updated_at timestamp").parquet(self.path)

    def load(self, slot: str) -> str | None:
        found = self._versions()
        if found is None:
            return None
        row = found.where(F.col("slot_name") == slot).orderBy(F.desc(lsn_number(F.col("last_lsn"))), F.desc("updated_at")).limit(1).collect()
        return row[0]["last_lsn"] if row else None

    def save(self, slot: str, lsn: str) -> None:
        """Equal positions are allowed, smaller ones are a ValueError."""
        before = self.load(slot)
        if before is not None and parse_lsn(lsn) < parse_lsn(before):
            raise ValueError(f"{lsn} lies before the checkpoint {before}")
        row = self.spark.range(1).select(F.lit(slot).alias("slot_name"), F.lit(lsn).alias("last_lsn"), F.current_timestamp().alias("updated_at"))
        row.coalesce(1).write.mode("append").parquet(self.path)

    def start(self, slot: str, configured: str | None = None) -> str:
        """The checkpoint, else the configured position, else 0/0."""
        return self.load(slot) or configured or "0/0"


class Slots:
    """Named cursors over a log, kept as small files in a shared folder: made if absent, found if already there."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def ensure(self, name: str, start: str = "0/0", temporary: bool = False) -> str:
        """created or exists. A slot that another session makes at the same moment counts as there."""
        if not name or not name.replace("_", "").isalnum() or name != name.lower():
            raise ValueError(f"not a slot's name: {name!r}")
        parse_lsn(start)
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if fs.exists(path):
            return "exists"
        row = self.spark.range(1).select(F.lit(name).alias("slot_name"), F.lit(start).alias("start_lsn"), F.lit(temporary).alias("temporary"))
        try:
            row.coalesce(1).write.mode("error").parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            return "exists"
        return "created"

    def list(self) -> DataFrame:
        return self.spark.read.schema("slot_name string, start_lsn string, temporary boolean").parquet(f"{self.path}/*")

    def drop(self, name: str) -> bool:
        """Whether there was such a slot."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


class TableApplier:
    """foreachBatch sink: keeps the log's changes that a table's state still needs, batch after batch.

    State rows are themselves a log of one insert or delete a key, dealt into `buckets` folders by the key's hash. A batch
    reads and rewrites only the buckets that it touches; a manifest then names each bucket's newest folder and the last
    position that the state holds, so position and state are one write (the acknowledgement: `position()` is what a slot
    may let go of). A replayed batch starts from the manifest before it, so delivery at least once gives each change's
    effect once. Manifests and folders that neither of the last two manifests names are deleted."""

    MANIFEST = "bucket int, batch long, lsn string"

    def __init__(self, spark: SparkSession, path: str, key: str, columns: dict[str, str], buckets: int = 16):
        self.spark, self.path, self.key, self.columns, self.buckets = spark, path.rstrip("/"), key, columns, buckets

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        names = [c.split()[0] for c in CHANGES.split(", ")]
        bucket = F.pmod(F.xxhash64(F.get_json_object("keys", f"$.{self.key}")), F.lit(self.buckets)).cast("int")
        log = batch.select(*names).withColumn("bucket", bucket)
        before = {r["bucket"]: r for r in self._manifest(batch_id - 1)}
        found = log.groupBy("bucket").agg(F.max(lsn_number(F.col("commit_lsn"))).alias("lsn")).collect()  # a row a bucket at most
        after = {k: (r["batch"], r["lsn"]) for k, r in before.items()}
        if found:
            last = max([int(r["lsn"]) for r in found] + [parse_lsn(r["lsn"]) for r in before.values()])
            old = [self._folder(r["bucket"], before[r["bucket"]]["batch"]) for r in found if r["bucket"] in before]
            for path in old:
                log = log.unionByName(self.spark.read.schema(CHANGES).parquet(path).withColumn("bucket", bucket))
            self._compact(log).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{batch_id}")
            after |= {r["bucket"]: (batch_id, "") for r in found}
            after = {k: (b, format_lsn(last)) for k, (b, _) in after.items()}
        rows = self.spark.createDataFrame([(k, b, lsn) for k, (b, lsn) in sorted(after.items())], self.MANIFEST)  # a row a bucket
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{batch_id}")
        self._tidy(batch_id, {b for b, _ in after.values()} | {r["batch"] for r in before.values()})

    def _folder(self, bucket: int, batch: int) -> str:
        return f"{self.path}/data/{batch}/bucket={bucket}"

    def _files(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), lambda x: self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x)

    def _manifest(self, batch_id: int) -> list:
        fs, path = self._files()
        if batch_id < 0 or not fs.exists(path(f"{self.path}/manifest/{batch_id}/_SUCCESS")):
            return []
        return self.spark.read.schema(self.MANIFEST).parquet(f"{self.path}/manifest/{batch_id}").collect()  # a row a bucket

    def _tidy(self, batch_id: int, needed: set) -> None:
        fs, path = self._files()
        for kind, keep in (("manifest", {batch_id, batch_id - 1}), ("data", needed | {batch_id})):
            if fs.exists(path(f"{self.path}/{kind}")):
                for status in fs.listStatus(path(f"{self.path}/{kind}")):
                    name = status.getPath().getName()
                    if name.isdigit() and int(name) < batch_id and int(name) not in keep:
                        fs.delete(status.getPath(), True)

    def _compact(self, log: DataFrame) -> DataFrame:
        """Per key: a delete or one insert that holds all that is known, at the position of the key's last change."""
        keyed = log.withColumn("_key", F.get_json_object("keys", f"$.{self.key}"))
        at = F.struct(lsn_number(F.col("commit_lsn")).alias("lsn"), F.col("seq"))
        last = keyed.groupBy("_key", "bucket").agg(F.max_by(F.struct("commit_lsn", "seq", "table_name", "operation", "commit_time", "keys"), at).alias("c")).select("_key", "bucket", "c.*")
        rows = final_state(log, self.key, dict.fromkeys(self.columns, "string")).withColumnRenamed(self.key, "_key")
        rows = rows.select("_key", F.to_json(F.struct(*self.columns), {"ignoreNullFields": "false"}).alias("new"))
        joined = last.join(rows, "_key", "left").withColumn("operation", F.when(F.col("new").isNull(), "delete").otherwise("insert")).withColumn("old", F.lit(None).cast("string"))
        return joined.select(*[c.split()[0] for c in CHANGES.split(", ")], "bucket")

    def changes(self, version: int) -> DataFrame:
        """The state after a batch (one of the last two), as a log."""
        out = self.spark.createDataFrame([], CHANGES)
        paths = [self._folder(r["bucket"], r["batch"]) for r in self._manifest(version)]
        return self.spark.read.schema(CHANGES).parquet(*paths) if paths else out

    def position(self, version: int) -> str:
        """The last commit position that the state after a batch holds: what the log's owner may be told."""
        return next((r["lsn"] for r in self._manifest(version)), "0/0")

    def table(self, version: int) -> DataFrame:
        return final_state(self.changes(version), self.key, self.columns)


def apply_stream(changes: DataFrame, applier: TableApplier, checkpoint: str) -> int:
    """Apply all that a streaming source has, in micro-batches; the number of the last batch."""
    query = changes.writeStream.foreachBatch(applier).option("checkpointLocation", checkpoint).trigger(availableNow=True).queryName(f"apply-{uuid.uuid4().hex[:8]}").start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return query.lastProgress["batchId"] if query.lastProgress else -1


def tumbling_counts(events: DataFrame, width: str, *keys: str) -> DataFrame:
    """Counts by event-time window and keys, for batch or stream; ts must be a timestamp (not ntz) in a stream."""
    return events.groupBy(F.window("ts", width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")
