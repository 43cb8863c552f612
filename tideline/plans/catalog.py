"""A catalog of schemas, tables, columns and foreign keys: canonical form, version, and tables of it for Spark."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.corpus import version as _digest


@dataclass(frozen=True)
class Column:
    name: str
    type: str = ""
    nullable: bool = True


@dataclass(frozen=True)
class ForeignKey:
    """A directed edge over one or more columns."""

    name: str
    columns: tuple[str, ...]
    ref_table: str
    ref_columns: tuple[str, ...]
    ref_schema: str = ""

    def valid(self) -> bool:
        return bool(self.columns) and len(self.columns) == len(self.ref_columns) and bool(self.ref_table)


@dataclass(frozen=True)
class Table:
    schema: str
    name: str
    columns: tuple[Column, ...] = ()
    primary_key: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()


@dataclass(frozen=True)
class Catalog:
    """Tables and the schemas that unqualified names are looked up in, in order."""

    tables: tuple[Table, ...]
    search_path: tuple[str, ...] = field(default=("public",))

    def canonical(self) -> "Catalog":
        """Tables, columns and foreign keys in order of name; keys keep their columns' order."""
        tables = []
        for t in self.tables:
            if not t.schema or not t.name:
                raise ValueError("a table needs a schema and a name")
            tables.append(Table(t.schema, t.name, tuple(sorted(t.columns, key=lambda c: c.name)), t.primary_key, tuple(sorted(t.foreign_keys, key=lambda k: (k.name, k.columns)))))
        return Catalog(tuple(sorted(tables, key=lambda t: (t.schema, t.name))), self.search_path)

    def version(self) -> str:
        """The same for the same content in any order."""
        return _digest(asdict(self.canonical()))

    def resolve(self, name: str, schema: str = "") -> Table | None:
        """By schema if one is given, else along the search path, else by order of schema."""
        low = name.lower()
        found = [t for t in self.tables if t.name.lower() == low and (not schema or t.schema.lower() == schema.lower())]
        path = [s.lower() for s in self.search_path]
        found.sort(key=lambda t: (path.index(t.schema.lower()) if t.schema.lower() in path else len(path), t.schema, t.name))
        return found[0] if found else None


def columns_table(spark: SparkSession, catalog: Catalog) -> DataFrame:
    rows = [(t.schema, t.name, c.name, c.type, c.nullable) for t in catalog.canonical().tables for c in t.columns]
    return spark.createDataFrame(rows, "schema string, table_name string, column_name string, type string, nullable boolean")


def edges_table(spark: SparkSession, catalog: Catalog) -> DataFrame:
    """A row a foreign key: its table, the table it refers to, and both lists of columns."""
    rows = [(t.schema, t.name, k.name, k.ref_schema or t.schema, k.ref_table, list(k.columns), list(k.ref_columns)) for t in catalog.canonical().tables for k in t.foreign_keys if k.valid()]
    return spark.createDataFrame(rows, "schema string, table_name string, key_name string, ref_schema string, ref_table string, columns array<string>, ref_columns array<string>")


def join_paths(edges: DataFrame, bound: DataFrame) -> DataFrame:
    """What can be joined to bound tables (schema, table_name, qualifier) by a foreign key in either direction: the table
    to join and its ON text, of composite keys all columns."""
    on = lambda left, a, right, b: F.array_join(F.zip_with(a, b, lambda x, y: F.concat(left, F.lit("."), x, F.lit(" = "), right, F.lit("."), y)), " AND ")
    key = F.concat_ws(".", "schema", "table_name")
    b = bound.select(key.alias("_key"), "qualifier")
    out = edges.join(b, F.concat_ws(".", "schema", "table_name") == F.col("_key")).select(F.col("ref_schema").alias("schema"), F.col("ref_table").alias("table_name"), on(F.col("qualifier"), F.col("columns"), F.col("ref_table"), F.col("ref_columns")).alias("on_expr"))
    into = edges.join(b, F.concat_ws(".", "ref_schema", "ref_table") == F.col("_key")).select("schema", "table_name", on(F.col("table_name"), F.col("columns"), F.col("qualifier"), F.col("ref_columns")).alias("on_expr"))
    both = out.unionByName(into).distinct()
    return both.join(bound.select("schema", "table_name"), ["schema", "table_name"], "left_anti")


def star_catalog() -> Catalog:
    """The shared test tables, with their keys."""
    fk = lambda name, column, table, ref: ForeignKey(name, (column,), table, (ref,))
    cols = lambda text: tuple(Column(c.split(":")[0], c.split(":")[1], False) for c in text.split())
    return Catalog((
        Table("public", "region", cols("r_regionkey:int r_name:text"), ("r_regionkey",)),
        Table("public", "nation", cols("n_nationkey:int n_name:text n_regionkey:int"), ("n_nationkey",), (fk("nation_region", "n_regionkey", "region", "r_regionkey"),)),
        Table("public", "customer", cols("c_custkey:bigint c_name:text c_nationkey:int c_acctbal:double c_mktsegment:text"), ("c_custkey",), (fk("customer_nation", "c_nationkey", "nation", "n_nationkey"),)),
        Table("public", "supplier", cols("s_suppkey:bigint s_name:text s_nationkey:int s_acctbal:double"), ("s_suppkey",), (fk("supplier_nation", "s_nationkey", "nation", "n_nationkey"),)),
        Table("public", "part", cols("p_partkey:bigint p_name:text p_brand:text p_type:text p_size:int p_retailprice:double"), ("p_partkey",)),
        Table("public", "orders", cols("o_orderkey:bigint o_custkey:bigint o_orderstatus:text o_totalprice:double o_orderdate:timestamp o_orderpriority:text"), ("o_orderkey",), (fk("orders_customer", "o_custkey", "customer", "c_custkey"),)),
        Table("public", "lineitem", cols("l_orderkey:bigint l_partkey:bigint l_suppkey:bigint l_linenumber:int l_quantity:double"), ("l_orderkey", "l_linenumber"), (
            fk("lineitem_orders", "l_orderkey", "orders", "o_orderkey"), fk("lineitem_part", "l_partkey", "part", "p_partkey"), fk("lineitem_supplier", "l_suppkey", "supplier", "s_suppkey"))),
        Table("sales", "returns", cols("l_orderkey:bigint l_linenumber:int reason:text"), ("l_orderkey", "l_linenumber"), (ForeignKey("returns_lineitem", ("l_orderkey", "l_linenumber"), "lineitem", ("l_orderkey", "l_linenumber"), "public"),)),
    ))
