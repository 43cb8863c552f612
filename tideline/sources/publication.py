"""A registry of publications: which tables a change stream covers, as a table (publication, table_name)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_$]{0,62}$"
_TABLE = r"^([A-Za-z_][A-Za-z0-9_$]{0,62}\.)?[A-Za-z_][A-Za-z0-9_$]{0,62}$"


def qualified(table: Column) -> Column:
    """The name with its schema, public if it has none."""
    return F.when(F.instr(table, ".") > 0, table).otherwise(F.concat(F.lit("public."), table))


def is_identifier(text: str) -> bool:
    return bool(re.match(_IDENTIFIER, text))


def normalized_tables(tables: DataFrame, column: str = "table_name") -> DataFrame:
    """Valid names, qualified, each once, in order."""
    good = tables.where(F.trim(column).rlike(_TABLE)).select(qualified(F.trim(column)).alias("table_name"))
    return good.distinct().orderBy("table_name")


def listed(registry: DataFrame, name: str) -> DataFrame:
    return registry.where(F.col("publication") == name).select("table_name").distinct().orderBy("table_name")


def reconcile(registry: DataFrame, wanted: DataFrame) -> DataFrame:
    """(publication, table_name, action) of every wanted table: `create` where the publication is new, `add` where it
    lacks the table, `keep` where it has it. Tables that are no longer wanted stay. wanted: publication, table_name."""
    asked = wanted.where(F.col("publication").rlike(_IDENTIFIER) & F.trim("table_name").rlike(_TABLE)).select("publication", qualified(F.trim("table_name")).alias("table_name")).distinct()
    have = registry.select("publication", "table_name").distinct().withColumn("has", F.lit(True))
    known = registry.select("publication").distinct().withColumn("known", F.lit(True))
    action = F.when(F.col("known").isNull(), "create").when(F.col("has").isNull(), "add").otherwise("keep")
    return asked.join(known, "publication", "left").join(have, ["publication", "table_name"], "left").select("publication", "table_name", action.alias("action"))


def outcome(actions: DataFrame) -> DataFrame:
    """created, reconciled or unchanged for each publication."""
    has = lambda a: F.bool_or(F.col("action") == a)
    return actions.groupBy("publication").agg(F.when(has("create"), "created").when(has("add"), "reconciled").otherwise("unchanged").alias("result"))


def ensured(registry: DataFrame, wanted: DataFrame) -> DataFrame:
    """The registry with what is wanted added."""
    new = reconcile(registry, wanted).where("action != 'keep'").select("publication", "table_name")
    return registry.select("publication", "table_name").distinct().unionByName(new)
