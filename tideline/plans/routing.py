"""Routing of queries to a cache, the database or past both, and the rolling metrics that it goes by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Estimated latency of each route, in ms.
ESTIMATES = {"LOCAL_CACHE": 5, "LOCAL_DATABASE": 100, "BYPASS": 200}


def complexity(operation: Column, has_cte: Column, recursive: Column, windows: Column, distinct: Column, aggregate: Column, database_ops: Column, n_tables: Column) -> Column:
    """0.1 for a SELECT, 0.3 for others; 0.3 for CTEs (0.2 more if recursive), 0.2 windows, 0.1 each for distinct,
    aggregates and database-specific operations, 0.2 for over 3 tables or 0.1 for over 1; 1 at most."""
    add = lambda flag, weight: F.when(flag, weight).otherwise(0.0)
    total = F.when(operation == "SELECT", 0.1).otherwise(0.3) + add(has_cte, 0.3) + add(has_cte & recursive, 0.2) + add(windows, 0.2) + add(distinct, 0.1) + add(aggregate, 0.1) + add(database_ops, 0.1)
    total = total + F.when(n_tables > 3, 0.2).when(n_tables > 1, 0.1).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), total), 6)


def strategy(cached: Column, load: Column, score: Column, memory_mb: Column, cache_mb: Column) -> Column:
    """A cached query goes to the cache; one that isn't, very complex, and with memory below half of the cache's size
    goes past; all others go to the database."""
    return F.when(cached, "LOCAL_CACHE").when((score > 0.8) & (memory_mb < cache_mb / 2), "BYPASS").otherwise("LOCAL_DATABASE")


def reason(cached: Column, load: Column, route: Column) -> Column:
    return F.when(cached & (load > 0.7), "high load").when(cached, "cached").when(route == "BYPASS", "too complex for memory").otherwise("default")


def route(queries: DataFrame) -> DataFrame:
    """queries (query_id, cached, load, score, memory_mb, cache_mb) with strategy, reason and estimate_ms."""
    way = strategy(F.col("cached"), F.col("load"), F.col("score"), F.col("memory_mb"), F.col("cache_mb"))
    out = queries.withColumn("strategy", way).withColumn("reason", reason(F.col("cached"), F.col("load"), F.col("strategy")))
    sizes = F.create_map(*[F.lit(x) for pair in ESTIMATES.items() for x in pair])
    return out.withColumn("estimate_ms", F.element_at(sizes, F.col("strategy")))


def rolling_metrics(events: DataFrame, now: Column, window: str = "5 minutes", recent: str = "1 minute", most: int = 0, kept: int = 0) -> DataFrame:
    """Over the events (ts, cache_hit, response_us, strategy) of the window before a time: how many, mean response,
    queries a second, and the hit rate of the most recent part. One row; old events simply fall out of the filter. Of
    more than `most` events in the window only the newest `kept` count, as a bounded buffer would keep them (0: all)."""
    if most:
        inside = events.where((F.col("ts") > now - F.expr(f"INTERVAL {window}")) & (F.col("ts") <= now))
        if len(inside.select(F.lit(1)).limit(most + 1).take(most + 1)) > most:
            events = inside.orderBy(F.desc("ts")).limit(kept)
    age = lambda span: (F.col("ts") > now - F.expr(f"INTERVAL {span}")) & (F.col("ts") <= now)
    seconds = {"minute": 60, "minutes": 60, "hour": 3600, "hours": 3600, "day": 86400, "days": 86400}
    number, unit = window.split()
    return events.where(age(window)).agg(
        F.count("*").alias("n"), (F.sum("response_us") / F.count("*")).alias("mean_us"), (F.count("*") / (int(number) * seconds[unit])).alias("per_second"),
        (F.count_if(F.col("cache_hit") & age(recent)) / F.count_if(age(recent))).alias("recent_hit_rate"),
    )


def strategy_stats(events: DataFrame) -> DataFrame:
    """Executions, hits and mean response for each strategy."""
    return events.groupBy("strategy").agg(F.count("*").alias("n"), F.count_if("cache_hit").alias("hits"), (F.sum("response_us") / F.count("*")).alias("mean_us"))
