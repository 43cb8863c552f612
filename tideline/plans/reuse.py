"""Reuse of results: components of a query, a registry of cached ones, matching, scores and a cost gate.

Components are clause-level pieces of a statement, each with a signature that holds its whole context (tables, join
conditions, filters), so equal signatures mean equal rows. A registry is a DataFrame of cached components; matching is a
join on signature, then a superset test: same type and tables, cached columns cover the needed ones, and every cached
filter is among the query's (so the cached rows contain the needed ones). Driver-side plans use Catalyst's own hashes.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import analyze
from tideline.functions.sqlparse import Node, parse

#: Default costs of components, the credit of a superset match, and the clauses' dependencies.
COSTS = {"JOIN": 20.0, "AGGREGATION": 10.0, "WHERE": 5.0, "FROM": 1.0}
SUPERSET_CREDIT = 0.8
MS_PER_COST = 1.0
#: Run and retrieval times in us, and the least speed-up worth while.
ORIGINAL_US, RETRIEVAL_US, LATE_US, LEAST_SPEEDUP = 10_000.0, 1.0, 0.5, 2.0
DEPENDS_ON = {"WHERE": "FROM", "AGGREGATION": "GROUP_BY"}
COMPONENT = "type:string, signature:string, sql:string, tables:array<string>, columns:array<string>, filters:array<string>, deps:array<string>, cost:double"


def _signature(kind: str, *context: str) -> str:
    """The kind and 8 bytes of a digest."""
    return f"{kind}_{hashlib.md5(chr(0).join(context).encode(), usedforsecurity=False).hexdigest()[:16]}"


def components(sql) -> list[dict]:
    """The clause-level components of a statement's first returned SELECT."""
    tree = parse(sql) if isinstance(sql, str) else sql
    top = analyze.top_selects(tree)
    if not top:
        return []
    s = top[0]
    tables = analyze.tables(tree)["base"]
    source = ", ".join(_source_text(f) for f in s.from_)
    wheres = sorted(analyze.render(c) for c in analyze.conjuncts(s.where))
    where = " AND ".join(wheres)
    group = ", ".join(map(analyze.render, s.group))
    names = lambda nodes: sorted({c.name for n in nodes for c in n.walk(into_queries=False) if c.kind == "col"})
    found: list[dict] = []

    def add(kind: str, text: str, columns: list[str], *context: str) -> None:
        found.append({"type": kind, "signature": _signature(kind, source, *context, text), "sql": text, "tables": tables, "columns": columns, "filters": wheres, "deps": [], "cost": COSTS.get(kind, 1.0)})

    items = ", ".join(analyze.render(i.expr) for i in s.items)
    add("SELECT", items, names(i.expr for i in s.items), where, group)
    if s.from_:
        add("FROM", source, [])
    if s.where is not None:
        add("WHERE", where, names([s.where]))
    joins = analyze.joins(Node("select", distinct=None, items=[], from_=s.from_, where=None, group=[], having=None, windows={}, order=[], limit=None, offset=None, ctes=[], recursive=False))
    if joins:
        add("JOIN", "; ".join(f"{j['type']} {j['left_table']} {j['right_table']} {j['on_expr'] or ','.join(j['keys'])}" for j in joins), sorted({c for j in joins for k in j["keys"] for c in k.split("=")}))
    if s.group:
        add("GROUP_BY", group, names(s.group), where)
    calls = [c for i in s.items for c in i.expr.walk(into_queries=False) if analyze._is_aggregate(c)]
    if calls:
        add("AGGREGATION", ", ".join(map(analyze.render, calls)), names(calls), where, group)
    outer = tree if tree.kind in ("select", "setop") else s
    order = ", ".join(map(analyze.render, outer.order))
    if order:
        add("ORDER_BY", order, names(outer.order), where, group, items)
    if outer.limit is not None or outer.offset is not None:
        add("LIMIT", f"{analyze.render(outer.limit) or 'ALL'} OFFSET {analyze.render(outer.offset) or '0'}", [], where, group, items, order)
    by_type = {c["type"]: c["signature"] for c in found}
    for c in found:
        if DEPENDS_ON.get(c["type"]) in by_type:
            c["deps"] = [by_type[DEPENDS_ON[c["type"]]]]
    return found


def _source_text(n: Node) -> str:
    if n.kind == "table":
        return n.name + (f" {n.alias}" if n.alias else "")
    if n.kind == "derived":
        return f"({' '.join(n.text.split())}) {n.alias or ''}".strip()
    if n.kind == "join":
        how = f" ON {analyze.render(n.on)}" if n.on is not None else f" USING ({', '.join(n.using)})" if n.using else ""
        return f"{_source_text(n.left)} {n.type.upper()} JOIN {_source_text(n.right)}{how}"
    return f"{n.name}({', '.join(map(analyze.render, n.args))})"


def query_components(queries: DataFrame, id_col: str = "query_id", sql_col: str = "sql") -> DataFrame:
    """A row for each component of each query that parses."""
    from tideline.operators.corpus import EXTRACTORS, analyzed

    EXTRACTORS.setdefault("components", (components, f"array<struct<{COMPONENT}>>"))
    return analyzed(queries, "components", sql_col=sql_col).select(F.col(id_col).alias("query_id"), F.posexplode("components").alias("pos", "c")).select("query_id", "pos", "c.*")


def match(needed: DataFrame, registry: DataFrame, at: Column, model: DataFrame | None = None) -> DataFrame:
    """needed with how each component is served at a time: `exact`, `superset` or `new`, by which cached one, and the
    cost that saves. registry: signature, type, tables, columns, filters, cost, valid_until. A cached component of the
    same type is a superset if it has at least the needed tables and columns, and no filter beyond the needed ones, of
    which there is one at least (what is left of them is applied to the cached rows). model: (type, cost), which goes
    before the default costs; a cached component's own cost goes before both. The registry is joined on signature, then on
    type and the first needed table: equi-joins, so neither side is broadcast unless Spark knows it is small."""
    if model is not None:
        known = model.select("type", F.col("cost").alias("_model"))
        needed = needed.join(known, "type", "left").withColumn("cost", F.coalesce("_model", "cost")).drop("_model")
    live = registry.where(F.col("valid_until") > at)
    exact = live.groupBy("signature").agg(F.max("cost").alias("exact_cost"))
    wide = live.select("type", F.explode(F.array_distinct("tables")).alias("table"), F.col("tables").alias("wide_tables"), F.col("signature").alias("wide_signature"), F.col("columns").alias("wide_columns"), F.col("filters").alias("wide_filters"), F.col("cost").alias("wide_cost"))
    rows = needed.join(exact, "signature", "left").withColumn("table", F.array_min("tables"))
    rows = rows.join(wide, ["type", "table"], "left")
    within = lambda a, b: F.size(F.array_except(a, b)) == 0
    covers = within("tables", "wide_tables") & within("columns", "wide_columns") & within("wide_filters", "filters") & (F.size("filters") > 0)
    keys = [c for c in needed.columns if c not in ("tables", "columns", "filters", "deps", "sql")]
    best = rows.groupBy(*keys).agg(F.max("exact_cost").alias("exact_cost"), F.min(F.when(covers, F.col("wide_signature"))).alias("wide_signature"), F.max(F.when(covers, F.col("wide_cost"))).alias("wide_cost"))
    how = F.when(F.col("exact_cost").isNotNull(), "exact").when(F.col("wide_signature").isNotNull(), "superset").otherwise("new")
    saved = F.when(how == "exact", F.greatest("exact_cost", "cost")).when(how == "superset", SUPERSET_CREDIT * F.col("cost")).otherwise(0.0)
    source = F.when(how == "exact", F.col("signature")).when(how == "superset", F.col("wide_signature"))
    return best.select(*keys, how.alias("how"), source.alias("source"), saved.alias("saved"))


def gate(matched: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Per query: total and saved cost, saved time, whether the plan is used (something is reused and saves at least the
    threshold) and its steps: cached, compute, and merge if there are both."""
    per = matched.groupBy("query_id").agg(F.sum("cost").alias("total_cost"), F.sum("saved").alias("saved_cost"), F.count_if(F.col("how") != "new").alias("reused"), F.count("*").alias("components"))
    used = (F.col("reused") > 0) & (F.col("saved_cost") >= threshold)
    steps = F.when(~used, F.lit("compute")).when(F.col("reused") == F.col("components"), "cached").otherwise("cached,compute,merge")
    return per.select("query_id", "total_cost", F.when(used, F.col("saved_cost")).otherwise(0.0).alias("saved_cost"), F.when(used, F.col("saved_cost") * MS_PER_COST).otherwise(0.0).alias("saved_ms"), used.alias("optimized"), steps.alias("steps"))


# scores
def complexity_score(m: dict) -> Column:
    """10 + 20 a subquery + 30 a CTE + 40 if recursive + 10 a nesting level + type weights + 10 a parameter + 5 a reuse;
    m names the count columns: subqueries, ctes, recursive, depth, joins, aggregates, windows, distinct, order, parameters, reuses."""
    c = {k: F.col(v) for k, v in m.items()}
    return 10 + 20 * c["subqueries"] + 30 * c["ctes"] + 40 * c["recursive"].cast("int") + 10 * c["depth"] + 25 * c["joins"] + 15 * c["aggregates"] + 10 * c["windows"] + 8 * c["distinct"] + 5 * c["order"] + 10 * c["parameters"] + 5 * c["reuses"]


def cacheable_score(deterministic: Column, aggregate: Column) -> Column:
    """0.8, less 0.3 if the current time or chance plays a part, more 0.2 for an aggregate; within 0 and 1."""
    score = F.lit(0.8) - F.when(deterministic, 0.0).otherwise(0.3) + F.when(aggregate, 0.2).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6)


def parsed_complexity(counts: dict[str, Column]) -> Column:
    """1 + 2 a table + 1 a column + 3 an aggregate + 5 a join + 10 a subquery + 8 a CTE + 6 a window + 4 distinct + 3 a
    database-specific operation."""
    weights = {"tables": 2, "columns": 1, "aggregations": 3, "joins": 5, "subqueries": 10, "ctes": 8, "windows": 6, "distinct": 4, "database_ops": 3}
    return sum((weights[k] * v for k, v in counts.items()), F.lit(1))


def complexity_level(score: Column) -> Column:
    return F.when(score <= 10, "simple").when(score <= 25, "medium").when(score <= 50, "high").otherwise("very_high")


def action(cacheability: Column, complexity: Column, nested: Column, advanced: Column) -> Column:
    """What to do about a query: nested means subqueries or CTEs, advanced windows or distinct."""
    return (
        F.when(cacheability < 0.5, "skip_caching").when(complexity < 15, "simple_caching").when(nested, "decomposition_recommended")
        .when(advanced, "advanced_strategies").otherwise("standard_caching")
    )


def subquery_cost_us(text: Column, level: Column) -> Column:
    """100 + 200 with a join + 150 with an order + 100 with a group + 75 with distinct + 50 a nesting level, in us."""
    has = lambda word: F.upper(text).contains(word).cast("int")
    return 100 + 200 * has("JOIN") + 150 * has("ORDER BY") + 100 * has("GROUP BY") + 75 * has("DISTINCT") + 50 * level


def subqueries(sql) -> list[dict]:
    """Nested queries: kind (scalar, exists, in, derived, cte), text, nesting level from 1, tables, whether it is
    correlated (uses a qualifier that its own FROM doesn't bring), and whether it is deterministic."""
    tree = parse(sql) if isinstance(sql, str) else sql
    kinds = {"subquery": "scalar", "exists": "exists", "inquery": "in", "derived": "derived", "cte": "cte"}
    out: list[dict] = []

    def visit(n: Node, level: int) -> None:
        for child in n.children():
            if child.kind in kinds and hasattr(child, "text"):
                own = {f.alias or getattr(f, "name", "") for q in child.query.walk() if q.kind == "select" for root in q.from_ for f in root.walk(into_queries=False) if f.kind in ("table", "derived", "tablefunc")}
                used = {c.table for c in child.query.walk() if c.kind == "col" and c.table}
                calls = [c.name for c in child.query.walk() if c.kind == "call"]
                out.append({"kind": kinds[child.kind], "text": " ".join(child.text.split()), "level": level, "tables": analyze.tables(child.query)["base"], "correlated": bool(used - own), "deterministic": not any(c in analyze.VOLATILE_FUNCTIONS for c in calls)})
                visit(child, level + 1)
            else:
                visit(child, level)

    visit(tree, 1)
    return out


def word_similarity(a: Column, b: Column) -> Column:
    """Share of words in common, of all words of both."""
    x, y = (F.array_distinct(F.split(F.upper(F.trim(t)), r"\s+")) for t in (a, b))
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def reuse_opportunities(candidates: DataFrame, cached: DataFrame, least: float = 0.5) -> DataFrame:
    """Cached queries worth using for candidate texts: equal normalised texts score 0.95 (equal texts 1.0), others their
    word similarity; 0.05 more for over 10 hits, 0.03 if recent, 0.1 times the tables in common; 1 at most.

    Texts are met over the tables they share (an equi-join on table), so unrelated queries never pair up."""
    left = candidates.withColumn("tbl", F.explode("tables"))
    right = cached.select(F.col("cached_id"), F.col("text").alias("cached_text"), F.col("tables").alias("cached_tables"), "hits", "recent", F.col("tables").alias("_t")).withColumn("tbl", F.explode("_t")).drop("_t")
    met = left.join(right, "tbl").drop("tbl").dropDuplicates(["query_id", "cached_id"])
    mask = lambda c: F.regexp_replace(F.regexp_replace(F.upper(F.trim(c)), r"'[^']*'|\b\d+(\.\d+)?\b", "?"), r"\s+", " ")
    a, b = F.col("text"), F.col("cached_text")
    base = F.when(a == b, 1.0).when(mask(a) == mask(b), 0.95).otherwise(word_similarity(a, b))
    overlap = F.size(F.array_intersect("tables", "cached_tables")) / F.size(F.array_union("tables", "cached_tables"))
    score = F.least(F.lit(1.0), base + F.when(F.col("hits") > 10, 0.05).otherwise(0.0) + F.when(F.col("recent"), 0.03).otherwise(0.0) + 0.1 * overlap)
    return met.withColumn("score", F.round(score, 6)).where(F.col("score") >= least).select("query_id", "cached_id", "score")


def validated(found: DataFrame, cached: DataFrame, now: Column, original_us: Column | None = None) -> DataFrame:
    """Opportunities (query_id, cached_id, score) with whether each is worth while, why not, its speed-up and what it
    saves, the most saving first by `place`: the cached entry is there, not expired (created + ttl_s, no ttl is for ever),
    and at least `LEAST_SPEEDUP` times faster. cached: cached_id, created, ttl_s; original_us: by default 10 ms."""
    from pyspark.sql import Window

    rows = found.join(cached.select("cached_id", "created", "ttl_s", F.lit(True).alias("there")), "cached_id", "left")
    original = original_us if original_us is not None else F.lit(ORIGINAL_US)
    retrieval = F.when(now - F.col("created") > F.expr("INTERVAL 1 HOUR"), RETRIEVAL_US + LATE_US).otherwise(RETRIEVAL_US)
    speed = F.round(original / retrieval, 4)
    expired = (F.col("ttl_s") > 0) & (now > F.col("created") + F.make_dt_interval(secs=F.col("ttl_s")))
    why = F.when(F.col("there").isNull(), "gone").when(expired, "expired").when(speed < LEAST_SPEEDUP, "too little gain")
    saving = original - retrieval
    order = Window.partitionBy("query_id").orderBy(F.desc("saving_us"), F.desc("score"), "cached_id")
    out = rows.select("query_id", "cached_id", "score", why.isNull().alias("valid"), F.coalesce(why, F.lit("")).alias("why"), speed.alias("speedup"), saving.alias("saving_us"))
    return out.withColumn("place", F.row_number().over(order))


def compatible(cached_tables, cached_columns, tables, columns) -> Column:
    """Whether a cached schema holds all needed tables and columns."""
    return (F.size(F.array_except(tables, cached_tables)) == 0) & (F.size(F.array_except(columns, cached_columns)) == 0)


def stored(registry: DataFrame, new: DataFrame, now: Column, ttl_s: int = 3600) -> DataFrame:
    """A registry table with components added: each signature once, the newest entry; those expired at `now` go.
    registry and new: signature, type, cost; registry also valid_until."""
    from pyspark.sql import Window

    fresh = new.withColumn("valid_until", now + F.make_dt_interval(secs=F.lit(ttl_s)))
    newest = Window.partitionBy("signature").orderBy(F.desc("valid_until"), F.desc("cost"))
    both = registry.where(F.col("valid_until") > now).unionByName(fresh)
    return both.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


#: The words a statement may begin with.
STATEMENT_STARTS = ["SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "DROP", "ALTER", "WITH"]


def text_problem(sql: Column, n_tables: Column) -> Column:
    """What is wrong with a statement's text, or null: rules on the text alone, then that a FROM has brought tables."""
    up = F.upper(F.trim(sql))
    starts = F.lit(False)
    for word in STATEMENT_STARTS:
        starts = starts | up.startswith(word)
    return (
        F.when(up.contains("SYNTAX ERROR"), "syntax error words").when(up.contains("INVALID") & ~up.contains("WHERE"), "invalid").when(~starts, "no statement keyword")
        .when(up.startswith("SELECT") & up.contains("FROM") & ~up.contains("DUAL") & (F.coalesce(n_tables, F.lit(0)) == 0), "FROM without tables")
    )


class PlanRegistry:
    """Cached DataFrames by Catalyst's semantic hash, with a time to live; expired ones are unpersisted on lookup.

    Spark itself substitutes a cached subtree where it recurs; the registry adds expiry, counts and exact lookup. A result
    that Catalyst takes to be larger than `most_bytes` is not kept, and the oldest go once there are `most_entries`; what is
    kept spills to disk."""

    def __init__(self, spark: SparkSession, ttl_s: float = 3600.0, clock=None, most_bytes: int = 1 << 32, most_entries: int = 100):
        import time

        self.spark, self.ttl_s, self.clock, self.entries = spark, ttl_s, clock or time.monotonic, {}
        self.most_bytes, self.most_entries = most_bytes, most_entries

    def put(self, df: DataFrame) -> int | None:
        """The entry's key, or None if the result is too large to keep."""
        if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > self.most_bytes:
            return None
        key = df.semanticHash()
        self.expire()
        while len(self.entries) >= self.most_entries and key not in self.entries:
            self.entries.pop(next(iter(self.entries)))[0].unpersist()
        self.entries[key] = (df.persist(), self.clock() + self.ttl_s)
        return key

    def get(self, df: DataFrame) -> DataFrame | None:
        self.expire()
        found = self.entries.get(df.semanticHash())
        return found[0] if found and found[0].sameSemantics(df) else None

    def expire(self) -> int:
        old = [k for k, (_, until) in self.entries.items() if until <= self.clock()]
        for k in old:
            self.entries.pop(k)[0].unpersist()
        return len(old)

    def clear(self) -> None:
        for df, _ in self.entries.values():
            df.unpersist()
        self.entries.clear()
