"""The graph of queries: which may be computed from which, what a table's change affects, and chains of reuse.

Nodes: query_id, sql, fingerprint, tables, operation, is_aggregate. Edges: src depends on dst, if dst's tables are all
among src's, dst has some, and both do the same operation. Queries meet over the tables that they share, so the work
follows the pairs that have a table in common.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nodes(queries: DataFrame) -> DataFrame:
    """Nodes of (query_id, sql) rows; a later row of an id takes the place of the earlier; texts that don't parse go."""
    from tideline.operators.corpus import analyzed

    found = analyzed(queries, "metadata", "fingerprint").where("error is null")
    return found.select("query_id", "sql", "fingerprint", F.transform("metadata.tables", F.lower).alias("tables"), F.col("metadata.operation").alias("operation"), F.col("metadata.is_aggregate").alias("is_aggregate"))


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs whose tables meet, with the number in common; right's columns are prefixed c_."""
    other = right.select(*[F.col(c).alias(f"c_{c}") for c in right.columns])
    # sets of tables meet, of which there are far fewer than queries; queries follow by their set
    key = lambda c: F.array_sort(F.array_distinct(c))
    sets = [df.select(key(c).alias(s)).distinct().withColumn("tbl", F.explode(s)) for df, c, s in ((left, "tables", "_set"), (other, "c_tables", "_c_set"))]
    met = sets[0].join(sets[1], "tbl").groupBy("_set", "_c_set").agg(F.count("*").alias("shared"))
    return met.join(left.withColumn("_set", key("tables")), "_set").join(other.withColumn("_c_set", key("c_tables")), "_c_set").drop("_set", "_c_set")


def dependencies(graph: DataFrame) -> DataFrame:
    """Edges (src, dst); a node never depends on itself."""
    met = _met(graph, graph)
    inside = F.col("shared") == F.size(F.array_distinct("c_tables"))
    return met.where(inside & (F.col("operation") == F.col("c_operation")) & (F.col("query_id") != F.col("c_query_id"))).select(F.col("query_id").alias("src"), F.col("c_query_id").alias("dst"))


def affected(graph: DataFrame, edges: DataFrame, table: str) -> DataFrame:
    """query_id of the queries that read a table and, transitively, of all that depend on them.

    Breadth first: each round joins the edges with the last round's queries only. A round's result is written to the
    shared folder, so rounds don't pile up in one plan, and cycles end when a round finds nothing new."""
    from tideline.streaming.local import written

    fresh = written(graph.where(F.array_contains("tables", table.lower())).select("query_id").distinct(), "affected")
    reached = fresh
    while not fresh.isEmpty():
        upward = edges.join(fresh, edges["dst"] == fresh["query_id"], "left_semi").select(F.col("src").alias("query_id")).distinct()
        fresh = written(upward.join(reached, "query_id", "left_anti"), "affected")
        reached = reached.unionByName(fresh)
    return reached


def remove(graph: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without some queries (gone: query_id); edges go at either end."""
    ids = gone.select(F.col("query_id").alias("_gone")).distinct()
    kept = edges.join(ids, edges["src"] == F.col("_gone"), "left_anti").join(ids, edges["dst"] == F.col("_gone"), "left_anti")
    return graph.join(ids, graph["query_id"] == F.col("_gone"), "left_anti"), kept


def dependency_chain(edges: DataFrame, start: str) -> DataFrame:
    """(step, query_id): what a query depends on, each after what it needs, and the query itself last. Breadth-first rounds of joins find the edges
    below the query; only those, the chain's own, are put in order on the driver."""
    from tideline.streaming.local import written

    spark = edges.sparkSession
    fresh = spark.createDataFrame([(start,)], "node string")
    below, seen = None, fresh
    while not fresh.isEmpty():
        step = written(edges.join(fresh, edges["src"] == fresh["node"], "left_semi"), "chain")
        below = step if below is None else below.unionByName(step)
        fresh = written(step.select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"), "chain")
        seen = seen.unionByName(fresh)
    order = chain([tuple(r) for r in below.select("src", "dst").collect()], start)
    return spark.createDataFrame(list(enumerate(order, 1)), "step int, query_id string")


def chain(edges: list[tuple[str, str]], start: str) -> list[str]:
    """What a query depends on, in an order in which each comes after what it needs; cycles are cut where they close."""
    below: dict[str, list[str]] = {}
    for a, b in edges:
        below.setdefault(a, []).append(b)
    out, seen, stack = [], {start}, [(start, iter(sorted(below.get(start, []))))]
    while stack:
        node, rest = stack[-1]
        for nxt in rest:
            if nxt not in seen:
                seen.add(nxt)
                stack.append((nxt, iter(sorted(below.get(nxt, [])))))
                break
        else:
            out.append(node)
            stack.pop()
    return out


def reusable(wanted: DataFrame, graph: DataFrame) -> DataFrame:
    """(query_id, cached_id, confidence) of graph nodes that could serve each wanted query: their tables are among its.
    Confidence 0.7, 0.2 more for the same operation, 0.1 more if both or neither aggregate."""
    met = _met(wanted, graph).where((F.col("shared") == F.size(F.array_distinct("c_tables"))) & (F.col("operation") == F.col("c_operation")))
    score = F.lit(0.7) + F.when(F.col("operation") == F.col("c_operation"), 0.2).otherwise(0.0) + F.when(F.col("is_aggregate") == F.col("c_is_aggregate"), 0.1).otherwise(0.0)
    return met.select("query_id", F.col("c_query_id").alias("cached_id"), F.round(score, 6).alias("confidence"))


def reuse_chain(wanted: DataFrame, graph: DataFrame, top: int = 3) -> DataFrame:
    """(query_id, step, node): the best cached queries, then the query's own computation; nothing if none serves it."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("confidence"), "cached_id")
    best = reusable(wanted, graph).withColumn("step", F.row_number().over(order)).where(F.col("step") <= top).select("query_id", "step", F.col("cached_id").alias("node"))
    last = best.groupBy("query_id").agg((F.max("step") + 1).alias("step")).withColumn("node", F.lit("compute"))
    return best.unionByName(last)


def stats(graph: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: queries, edges, most dependencies, most dependents, tables."""
    out = edges.groupBy("src").agg(F.count("*").alias("n")).agg(F.max("n").alias("most_dependencies"))
    into = edges.groupBy("dst").agg(F.count("*").alias("n")).agg(F.max("n").alias("most_dependents"))
    counts = graph.agg(F.count("*").alias("queries")).crossJoin(edges.agg(F.count("*").alias("edges")))  # single rows
    names = graph.select(F.explode("tables").alias("t")).agg(F.countDistinct("t").alias("tables"))
    return counts.crossJoin(out).crossJoin(into).crossJoin(names).na.fill(0)


def dot_lines(graph: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, a, b, line): the lines of the graph's DOT text, in order of the first three; made where the rows are."""
    ends = graph.sparkSession.createDataFrame([(0, "", "", "digraph queries {"), (3, "", "", "}")], "part int, a string, b string, line string")
    boxes = graph.select(F.lit(1).alias("part"), F.col("query_id").alias("a"), F.lit("").alias("b"), F.format_string('  "%s" [label="%s\\n%s"];', "query_id", "query_id", F.array_join("tables", ",")).alias("line"))
    arrows = edges.select(F.lit(2).alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"), F.format_string('  "%s" -> "%s";', "src", "dst").alias("line"))
    return ends.unionByName(boxes).unionByName(arrows)


def dot(graph: DataFrame, edges: DataFrame) -> str:
    """The DOT text of a graph that fits a picture."""
    return "\n".join(r["line"] for r in dot_lines(graph, edges).orderBy("part", "a", "b").collect()) + "\n"
