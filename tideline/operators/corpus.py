"""Analysis of a table of SQL texts: each row's statement is parsed and read on the executors, Arrow batch by batch."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions import analyze
from tideline.functions.sqlparse import SqlError, parse

_COLUMN = "struct<table:string, column:string, alias:string, is_agg:boolean>"
METADATA = f"""operation string, tables array<string>, cte_names array<string>, columns array<string>, aggregations array<string>,
select_columns array<{_COLUMN}>, where_conditions array<struct<column:{_COLUMN}, operator:string, value:string, is_param:boolean>>,
join_conditions array<struct<type:string, left_table:string, right_table:string, left_alias:string, right_alias:string, left_column:string, right_column:string, keys:array<string>, on_expr:string>>,
group_by array<string>, order_by array<string>, is_aggregate boolean, limit int, offset int, has_distinct boolean, distinct_columns array<string>,
has_subquery boolean, n_subqueries int, has_window_functions boolean, window_functions array<string>, window_partitions array<string>, window_order_by array<string>,
has_ctes boolean, is_recursive_cte boolean, has_database_specific_ops boolean, database_type string, database_operations array<string>,
time_bucket struct<function:string, interval:string, column:string, column_table:string>,
sliding_window struct<column:string, table:string, operator:string, duration_us:bigint, reference:string>,
is_deterministic boolean, set_operations array<string>"""
#: Schemas of the single extractors' elements, by the extractor's name.
EXTRACTORS: dict[str, tuple[Callable, str]] = {
    "metadata": (analyze.metadata, "struct<" + re.sub(r"(\w+) (array|string|boolean|int|struct)\b", r"\1:\2", METADATA) + ">"),
    "tables": (analyze.tables, "struct<base:array<string>, ctes:array<string>>"),
    "joins": (analyze.joins, "array<struct<type:string, left_table:string, right_table:string, left_alias:string, right_alias:string, left_column:string, right_column:string, keys:array<string>, on_expr:string>>"),
    "filters": (analyze.filters, f"array<struct<column:{_COLUMN}, operator:string, value:string, is_param:boolean>>"),
    "aggregates": (analyze.aggregates, "array<struct<func:string, alias:string, column:string, distinct:boolean, table:string>>"),
    "case_aggregates": (analyze.case_aggregates, "array<struct<alias:string, func:string, conditions:array<struct<kind:string, column:string, values:array<string>>>, then_column:string, then_const:string, else_const:string>>"),
    "compositions": (analyze.compositions, "array<struct<alias:string, terms:array<struct<sign:int, func:string, column:string, case:string>>>>"),
    "distinct_spec": (analyze.distinct_spec, "struct<has_distinct:boolean, columns:array<string>, has_count_distinct:boolean, count_columns:array<string>>"),
    "group_items": (analyze.group_items, "array<struct<kind:string, column:string, table:string, alias:string, position:int, raw_expr:string>>"),
    "temporal": (analyze.temporal, "struct<has_now:boolean, has_date_trunc:boolean, where_ranges:array<struct<column:string, table:string, kind:string, interval:string, start_time:string, end_time:string, operator:string>>>"),
    "time_bucket": (analyze.time_bucket, "struct<function:string, interval:string, column:string, column_table:string>"),
    "sliding_window": (analyze.sliding_window, "struct<column:string, table:string, operator:string, duration_us:bigint, reference:string>"),
    "json_paths": (analyze.json_paths, "array<struct<table:string, column:string, path:array<string>, operator:string, is_text:boolean>>"),
    "normalized": (analyze.normalize, "string"),
    "fingerprint": (analyze.fingerprint, "string"),
}


def analyzed(queries: DataFrame, *extractors: str, sql_col: str = "sql") -> DataFrame:
    """queries with one column for each named extractor, and `error`: null, or why the text can't be parsed (its
    extractor columns are then null). A null text is an error. Each distinct extractor walks the one parsed tree."""
    chosen = {name: EXTRACTORS[name] for name in extractors}
    names = queries.columns
    at = names.index(sql_col)
    kept = queries.schema
    out = queries.limit(0)
    for name, (_, kind) in chosen.items():
        out = out.withColumn(name, F.lit(None).cast(kind))
    schema = out.withColumn("error", F.lit(None).cast("string")).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            found: dict[str, list] = {name: [] for name in chosen}
            errors = []
            for sql in batch.column(at).to_pylist():
                try:
                    if sql is None:
                        raise SqlError("null")
                    tree = parse(sql)
                    row = {name: f(sql if name in ("normalized", "fingerprint") else tree) for name, (f, _) in chosen.items()}
                    errors.append(None)
                except (SqlError, RecursionError) as why:
                    row = dict.fromkeys(chosen)
                    errors.append(str(why) or "too deeply nested")
                for name, value in row.items():
                    found[name].append(value)
            columns = [batch.column(k) for k in range(len(kept))]
            columns += [pa.array(found[name], arrow.field(name).type) for name in chosen]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(errors, pa.string())], schema=arrow)

    return queries.mapInArrow(run, schema)


def version(value) -> str:
    """A digest of a plain value, the same for the same content in any order of keys."""
    return "sha256:" + hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
