"""The engine as a provider: queries as JSON rows, keys, capabilities, and a readiness probe."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.plans.dialect import to_spark


@dataclass(frozen=True)
class Capabilities:
    window_functions: bool = True
    recursive_ctes: bool = True
    json: bool = True
    arrays: bool = True
    streaming: bool = True


@dataclass(frozen=True)
class StrategyHints:
    """Which results can be maintained from changes alone: sums and counts, not minima or distinct counts."""

    incremental_sum: bool = True
    incremental_count: bool = True
    incremental_min_max: bool = False
    incremental_distinct: bool = False


@dataclass
class Provider:
    """Tables by name, their keys, and queries over them."""

    spark: SparkSession
    tables: dict[str, DataFrame]
    keys: dict[str, list[str]] = field(default_factory=dict)
    capabilities: Capabilities = Capabilities()
    hints: StrategyHints = StrategyHints()

    def query(self, sql: str, now: str | None = None, **params) -> DataFrame:
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)
        return self.spark.sql(to_spark(sql, now), args=params or None)

    def json_rows(self, sql: str, now: str | None = None, **params) -> DataFrame:
        """(row): the result's rows as JSON texts, made where the rows are."""
        df = self.query(sql, now, **params)
        return df.select(F.to_json(F.struct(*[df[c] for c in df.columns]), {"ignoreNullFields": "false"}).alias("row"))

    def query_json(self, sql: str, now: str | None = None, **params) -> Iterator[str]:
        """The same as an iterator, a partition at a time; for results that a client reads."""
        yield from (r[0] for r in self.json_rows(sql, now, **params).toLocalIterator(prefetchPartitions=True))

    def primary_keys(self, table: str) -> list[str]:
        """The declared key, else the first column of whole numbers or text (in the table's order) that has no null and no
        value twice, a sketch passes over columns that are far from unique."""
        if table in self.keys:
            return list(self.keys[table])
        if table not in self.tables:
            return []
        df = self.tables[table]
        names = [f.name for f in df.schema if f.dataType.simpleString() in ("int", "bigint", "string")]
        if not names:
            return []
        # a column that a sketch takes to be far from unique is not counted exactly
        rough = df.agg(F.count("*").alias("n"), *[F.approx_count_distinct(c, 0.05).alias(f"d{i}") for i, c in enumerate(names)]).first()
        for i, c in enumerate(names):
            if rough["n"] and rough[f"d{i}"] >= 0.7 * rough["n"]:
                exact = df.groupBy(c).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.count_if(F.col(c).isNull()).alias("nulls")).first()
                if exact["most"] == 1 and not exact["nulls"]:
                    return [c]
        return []

    def probe(self, shared_folder: str | None = None) -> list[tuple[str, str, str]]:
        """(check, ok or warn or fail, detail) of what a stream needs before it starts."""
        out = []
        major = int(self.spark.version.split(".")[0])
        out.append(("version", "ok" if major >= 4 else "fail", self.spark.version))
        zone = self.spark.conf.get("spark.sql.session.timeZone")
        out.append(("time_zone", "ok" if zone in ("UTC", "Etc/UTC") else "warn", zone))
        adaptive = self.spark.conf.get("spark.sql.adaptive.enabled")
        out.append(("adaptive", "ok" if adaptive == "true" else "warn", adaptive))
        for name, df in sorted(self.tables.items()):
            missing = [k for k in self.keys.get(name, []) if k not in df.columns]
            out.append((f"key:{name}", "fail" if missing else "ok" if self.keys.get(name) else "warn", ",".join(missing or self.keys.get(name, []))))
        if shared_folder:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(shared_folder)
            there = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path)
            out.append(("shared_folder", "ok" if there else "fail", shared_folder))
        return out
