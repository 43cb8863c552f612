"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm._common import discard, save


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node it reaches.

    Each round links every node's larger neighbours, then its smaller ones, to the smallest it knows; rounds grow with
    the logarithm of the longest path. Minima are aggregated before the shuffle and joined back, so that a node with
    very many neighbours is never gathered in one task. Edges with a null or with equal ends are passed over.
    """
    tidy = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = save(tidy.distinct(), "edges")
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        starred = save(large.where("u != v").distinct(), "large-star")
        least = starred.groupBy("u").agg(F.min("v").alias("m"))
        small = starred.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = save(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        discard(starred)
        discard(now)
        now, before = after, mark
        mark = _mark(now)
        if mark == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    out._tideline_path = now._tideline_path  # for discard()
    return out


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
