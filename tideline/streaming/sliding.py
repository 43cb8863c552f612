"""Sums over the last stretch of time, kept as a stream: rows leave the sum when they grow old.

A batch of rows is added to minute (or any `slot`) sums by key; a sum over `span` is that of the slots inside it, so state
is a row for each key and slot, never for each event, and expiry is a filter on slots. Late rows simply add to their slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slots(rows: DataFrame, keys: list[str], value: Column, slot: str) -> DataFrame:
    """keys, slot's start, total and count of each slot: what a batch adds."""
    return rows.groupBy(*keys, F.window("ts", slot)["start"].alias("slot")).agg(F.sum(value).alias("total"), F.count("*").alias("n"))


def merged(state: DataFrame | None, batch: DataFrame, keys: list[str], oldest: Column | None = None) -> DataFrame:
    """State with a batch's slots added; slots before `oldest` go."""
    both = batch if state is None else state.unionByName(batch)
    out = both.groupBy(*keys, "slot").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return out if oldest is None else out.where(F.col("slot") >= oldest)


def current(state: DataFrame, keys: list[str], now: Column, span: str) -> DataFrame:
    """Total and count by key over the slots that began within `span` before a time."""
    inside = (F.col("slot") > now - F.expr(f"INTERVAL {span}")) & (F.col("slot") <= now)
    return state.where(inside).groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
