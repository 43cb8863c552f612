"""PostgreSQL statements as Spark SQL: the tree of tideline.functions.sqlparse printed in Spark's dialect.

JSON arrows become get_json_object, existence and containment variant comparisons, DISTINCT ON a row_number, intervals
the parser's own microseconds, = ANY(ARRAY[..]) an IN, array and JSON aggregates their Spark forms, and the current time
a parameter when one is given. UPDATE and DELETE are printed as the SELECT of the rows that they leave behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.functions.analyze import _interval_text, _is_now, _literal
from tideline.functions.intervals import parse_interval
from tideline.functions.sqlparse import Node, SqlError, parse

#: PostgreSQL types and functions under Spark's names.
TYPES = {"int": "INT", "integer": "INT", "int4": "INT", "int8": "BIGINT", "bigint": "BIGINT", "smallint": "SMALLINT", "int2": "SMALLINT", "text": "STRING", "varchar": "STRING", "character varying": "STRING", "uuid": "STRING", "json": "STRING", "jsonb": "STRING", "numeric": "DECIMAL(38,10)", "decimal": "DECIMAL(38,10)", "float8": "DOUBLE", "double precision": "DOUBLE", "real": "FLOAT", "float4": "FLOAT", "bool": "BOOLEAN", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP_NTZ", "timestamp without time zone": "TIMESTAMP_NTZ", "timestamptz": "TIMESTAMP", "timestamp with time zone": "TIMESTAMP"}
FUNCTIONS = {"array_cat": "concat", "array_length": "size", "array_upper": "size", "unnest": "explode", "strpos": "instr", "btrim": "trim", "to_char": "date_format", "char_length": "length", "string_to_array": "split", "generate_series": "sequence"}


def to_spark(sql: str, now: str | None = None) -> str:
    """Spark SQL for a PostgreSQL statement; now: a timestamp literal that stands for the current time."""
    return Printer(now).statement(parse(sql))


def run(spark: SparkSession, sql: str, now: str | None = None, **tables: DataFrame) -> DataFrame:
    """Run a PostgreSQL statement over named DataFrames; for INSERT, UPDATE and DELETE the rows that it leaves behind."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    tree = parse(sql)
    if tree.kind != "insert":
        return spark.sql(Printer(now).statement(tree))
    printer = Printer(now)
    target = spark.table(tree.table.name)
    names = list(tree.columns) or target.columns
    new = spark.sql(printer.ctes(tree) + printer.query(tree.query)).toDF(*names)
    return target.unionByName(new, allowMissingColumns=True).select(*target.columns)


def _name(text: str) -> str:
    return text if text.isidentifier() and text == text.lower() else "`" + text.replace("`", "``") + "`"


def _string(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


class Printer:
    def __init__(self, now: str | None = None):
        self.now = now

    def statement(self, n: Node) -> str:
        if n.kind == "insert":
            columns = f" ({', '.join(map(_name, n.columns))})" if n.columns else ""
            return f"{self.ctes(n)}INSERT INTO {self.table(n.table)}{columns} {self.query(n.query)}"
        if n.kind == "update":
            return self.update(n)
        if n.kind == "delete":
            return self.delete(n)
        return self.query(n)

    def ctes(self, n: Node) -> str:
        if not n.ctes:
            return ""
        parts = [f"{_name(c.name)}{'(' + ', '.join(map(_name, c.columns)) + ')' if c.columns else ''} AS ({self.statement(c.query)})" for c in n.ctes]
        return f"WITH {'RECURSIVE ' if n.recursive else ''}{', '.join(parts)} "

    def query(self, n: Node) -> str:
        if n.kind == "setop":
            text = f"{self.branch(n.left)} {n.op.upper()}{' ALL' if n.all else ''} {self.branch(n.right)}"
        elif n.kind == "values":
            text = "VALUES " + ", ".join(f"({', '.join(map(self.x, row))})" for row in n.rows)
        else:
            text = self.select(n)
        if n.kind == "select" and n.distinct:
            return self.ctes(n) + text
        return self.ctes(n) + text + self.tail(n)

    def tail(self, n: Node) -> str:
        text = f" ORDER BY {', '.join(map(self.sort, n.order))}" if n.order else ""
        text += f" LIMIT {self.x(n.limit)}" if n.limit is not None else ""
        return text + (f" OFFSET {self.x(n.offset)}" if n.offset is not None else "")

    def branch(self, n: Node) -> str:
        plain = n.kind == "select" and not (n.order or n.limit or n.ctes or n.distinct)
        return self.query(n) if plain else f"({self.query(n)})"

    def select(self, n: Node) -> str:
        items = ", ".join(self.x(i.expr) + (f" AS {_name(i.alias)}" if i.alias else "") for i in n.items)
        body = self.body(n)
        if not n.distinct:
            return f"SELECT {'DISTINCT ' if n.distinct is not None else ''}{items}{body}"
        # DISTINCT ON: the first row of each key, in the statement's order
        keys = ", ".join(map(self.x, n.distinct))
        if any(i.expr.kind == "star" for i in n.items):
            names = "* EXCEPT (`#row`)"
        else:
            names = ", ".join(_name(i.alias or getattr(i.expr, "name", None) or f"column{k}") for k, i in enumerate(n.items))
            items = ", ".join(f"{self.x(i.expr)} AS {_name(i.alias or getattr(i.expr, 'name', None) or f'column{k}')}" for k, i in enumerate(n.items))
        order = ", ".join(map(self.sort, n.order)) or keys
        inner = f"SELECT {items}, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS `#row`{body}"
        limit = f" LIMIT {self.x(n.limit)}" if n.limit is not None else ""
        return f"SELECT {names} FROM ({inner}) WHERE `#row` = 1{limit}"

    def body(self, n: Node) -> str:
        text = f" FROM {', '.join(map(self.source, n.from_))}" if n.from_ else ""
        text += f" WHERE {self.x(n.where)}" if n.where is not None else ""
        text += f" GROUP BY {', '.join(map(self.x, n.group))}" if n.group else ""
        text += f" HAVING {self.x(n.having)}" if n.having is not None else ""
        return text + (" WINDOW " + ", ".join(f"{_name(k)} AS {self.window(w)}" for k, w in n.windows.items()) if n.windows else "")

    def table(self, n: Node) -> str:
        return (_name(n.schema) + "." if n.schema and n.schema != "public" else "") + _name(n.name)

    def source(self, n: Node) -> str:
        alias = f" AS {_name(n.alias)}" if getattr(n, "alias", None) else ""
        columns = f"({', '.join(map(_name, n.columns))})" if alias and getattr(n, "columns", None) else ""
        if n.kind == "table":
            return self.table(n) + alias + columns
        if n.kind == "derived":
            return f"{'LATERAL ' if n.lateral else ''}({self.query(n.query)}){alias}{columns}"
        if n.kind == "tablefunc":
            return f"(SELECT {FUNCTIONS.get(n.name, n.name)}({', '.join(map(self.x, n.args))}) AS {_name(n.columns[0] if n.columns else n.alias or n.name)}){alias}"
        kind = ("NATURAL " if n.natural else "") + {"inner": "JOIN", "cross": "CROSS JOIN"}.get(n.type, f"{n.type.upper()} JOIN")
        on = f" ON {self.x(n.on)}" if n.on is not None else f" USING ({', '.join(map(_name, n.using))})" if n.using else ""
        return f"{self.source(n.left)} {kind} {self.source(n.right)}{on}"

    def update(self, n: Node) -> str:
        """The table's rows after the update; a row that meets several source rows takes one of them."""
        target = n.table.alias or n.table.name
        new = ", ".join(f"{self.x(s.expr)} AS {_name(s.name)}" for s in n.sets)
        if not n.from_:
            cond = self.x(n.where) if n.where is not None else "true"
            changed = ", ".join(f"CASE WHEN {cond} THEN {self.x(s.expr)} ELSE {_name(s.name)} END AS {_name(s.name)}" for s in n.sets)
            return f"{self.ctes(n)}SELECT * EXCEPT ({', '.join(_name(s.name) for s in n.sets)}), {changed} FROM {self.table(n.table)} AS {_name(target)}"
        names = ", ".join(_name(s.name) for s in n.sets)
        where = f" WHERE {self.x(n.where)}" if n.where is not None else ""
        hit = f"SELECT {_name(target)}.* EXCEPT ({names}), {new} FROM {self.table(n.table)} AS {_name(target)}, {', '.join(map(self.source, n.from_))}{where}"
        cond = self.x(n.where) if n.where is not None else "true"
        rest = f"SELECT {_name(target)}.* EXCEPT ({names}), {', '.join(f'{_name(target)}.{_name(s.name)}' for s in n.sets)} FROM {self.table(n.table)} AS {_name(target)} WHERE NOT EXISTS (SELECT 1 FROM {', '.join(map(self.source, n.from_))} WHERE {cond})"
        return f"{self.ctes(n)}{hit} UNION ALL {rest}"

    def delete(self, n: Node) -> str:
        """The rows that the delete leaves."""
        target = f"{self.table(n.table)}{' AS ' + _name(n.table.alias) if n.table.alias else ''}"
        cond = self.x(n.where) if n.where is not None else "true"
        if not n.from_:
            return f"{self.ctes(n)}SELECT * FROM {target} WHERE NOT coalesce({cond}, false)"
        return f"{self.ctes(n)}SELECT * FROM {target} WHERE NOT EXISTS (SELECT 1 FROM {', '.join(map(self.source, n.from_))} WHERE {cond})"

    def sort(self, n: Node) -> str:
        nulls = n.nulls or ("first" if n.desc else "last")
        return f"{self.x(n.expr)}{' DESC' if n.desc else ''} NULLS {nulls.upper()}"

    def window(self, w: Node) -> str:
        parts = [_name(w.ref) if w.ref else "", f"PARTITION BY {', '.join(map(self.x, w.partition))}" if w.partition else "", f"ORDER BY {', '.join(map(self.sort, w.order))}" if w.order else "", w.frame.upper() if w.frame else ""]
        return f"({' '.join(p for p in parts if p)})"

    def json_path(self, n: Node) -> tuple[str, str]:
        """Base expression and `$.a.b` of a chain of JSON arrows."""
        path = ""
        while n.kind == "bin" and n.op in ("->", "->>", "#>", "#>>"):
            known, value = _literal(n.right)
            if not known:
                raise SqlError("a JSON path must be constant")
            steps = [p.strip().strip('"') for p in str(value).strip("{}").split(",")] if n.op[0] == "#" else [str(value)]
            path = "".join(f"[{s}]" if s.isdigit() else f"['{s}']" if not s.isidentifier() else f".{s}" for s in steps) + path
            n = n.left
        return self.x(n), "$" + path

    def x(self, n: Node) -> str:
        handler = getattr(self, "x_" + n.kind, None)
        if handler is None:
            raise SqlError(f"no Spark form of {n.kind}")
        return handler(n)

    def x_col(self, n):
        return (f"{_name(n.table)}." if n.table else "") + _name(n.name)

    def x_star(self, n):
        return f"{_name(n.table)}.*" if n.table else "*"

    def x_lit(self, n):
        return {"string": lambda: _string(n.value), "null": lambda: "NULL", "bool": lambda: str(n.value).lower(), "decimal": lambda: n.value}.get(n.type, lambda: str(n.value))()

    def x_param(self, n):
        return ":p" + n.name[1:] if n.name[1:].isdigit() else n.name

    def x_interval(self, n):
        return f"make_dt_interval(0, 0, 0, {parse_interval(n.text) / 1e6!r})"

    def x_cast(self, n):
        if n.type == "interval":
            text = _interval_text(n)
            if text is None:
                raise SqlError("an interval must be constant")
            return self.x_interval(Node("interval", text=text))
        base, _, size = n.type.partition("(")
        if n.type.endswith("[]"):
            return f"CAST({self.x(n.x)} AS ARRAY<{TYPES.get(n.type[:-2], n.type[:-2].upper())}>)"
        kind = f"DECIMAL({size}" if size and base in ("numeric", "decimal") else TYPES.get(base, n.type.upper())
        return f"CAST({self.x(n.x)} AS {kind})"

    def x_bin(self, n):
        if n.op in ("->", "->>", "#>", "#>>"):
            base, path = self.json_path(n)
            return f"get_json_object({base}, {_string(path)})"
        if n.op == "?":
            return self.has_key(n.left, n.right)
        if n.op in ("?|", "?&"):
            items = n.right.items if n.right.kind == "array" else []
            join = " OR " if n.op == "?|" else " AND "
            return "(" + join.join(self.has_key(n.left, i) for i in items) + ")"
        if n.op in ("@>", "<@"):
            return self.contains(*((n.left, n.right) if n.op == "@>" else (n.right, n.left)))
        if n.op == "^":
            return f"power({self.x(n.left)}, {self.x(n.right)})"
        if n.op in ("~", "~*", "!~", "!~*"):
            pattern = f"concat('(?i)', {self.x(n.right)})" if n.op.endswith("*") else self.x(n.right)
            return f"({'NOT ' if n.op[0] == '!' else ''}{self.x(n.left)} RLIKE {pattern})"
        text = f"{self.x(n.left)} {n.op.upper()} {self.x(n.right)}"
        return f"({text})"

    def has_key(self, value: Node, key: Node) -> str:
        """Whether a JSON object has a key, whatever its value; a JSON null is a value."""
        return f"coalesce(array_contains(json_object_keys({self.x(value)}), {self.x(key)}), false)"

    def contains(self, outer: Node, inner: Node) -> str:
        """Whether one JSON value holds another, of which one is a constant object. A constant's keys are all looked up,
        types and nulls told apart; a column in a constant needs each of its keys there, with an equal value."""
        import json

        known, value = _literal(inner)
        if known and isinstance(json.loads(value), dict):
            return "(" + (" AND ".join(self.holds(self.x(outer), "$", json.loads(value))) or f"try_parse_json({self.x(outer)}) IS NOT NULL") + ")"
        known, value = _literal(outer)
        if not known or not isinstance(json.loads(value), dict) or any(isinstance(v, (dict, list)) for v in json.loads(value).values()):
            raise SqlError("containment needs a constant object, a flat one if it is the outer")
        column, whole = self.x(inner), json.loads(value)
        at = lambda k: f"to_json(try_variant_get(try_parse_json({column}), {_string('$.' + k)}, 'variant'))"
        tests = [f"(NOT {self.has_key(inner, Node('lit', value=k, type='string'))} OR {at(k)} = {_string(json.dumps(v))})" for k, v in whole.items()]
        allowed = f"size(array_except(json_object_keys({column}), array({', '.join(map(_string, whole))}))) = 0" if whole else f"size(json_object_keys({column})) = 0"
        return "(" + " AND ".join([allowed, *tests]) + ")"

    def holds(self, outer: str, at: str, part: dict):
        import json

        for key, v in part.items():
            here = f"{at}.{key}"
            if isinstance(v, dict) and v:
                yield from self.holds(outer, here, v)
            elif isinstance(v, list):
                for item in v:
                    element = f"transform(try_cast(try_variant_get(try_parse_json({outer}), {_string(here)}, 'variant') AS ARRAY<VARIANT>), e -> to_json(e))"
                    yield f"coalesce(array_contains({element}, {_string(json.dumps(item, separators=(',', ':')))}), false)"
            else:
                yield f"coalesce(to_json(try_variant_get(try_parse_json({outer}), {_string(here)}, 'variant')) = {_string(json.dumps(v, separators=(',', ':')))}, false)"

    def x_neg(self, n):
        return f"-{self.x(n.x)}"

    def x_not(self, n):
        return f"(NOT {self.x(n.x)})"

    def x_is(self, n):
        return f"({self.x(n.x)} IS {'NOT ' if n.negated else ''}{'NULL' if n.what == 'unknown' else n.what.upper()})"

    def x_isdistinct(self, n):
        return f"({self.x(n.left)} IS {'NOT ' if n.negated else ''}DISTINCT FROM {self.x(n.right)})"

    def x_in(self, n):
        return f"({self.x(n.x)} {'NOT ' if n.negated else ''}IN ({', '.join(map(self.x, n.items))}))"

    def x_inquery(self, n):
        return f"({self.x(n.x)} {'NOT ' if n.negated else ''}IN ({self.query(n.query)}))"

    def x_exists(self, n):
        return f"EXISTS ({self.query(n.query)})"

    def x_subquery(self, n):
        return f"({self.query(n.query)})"

    def x_between(self, n):
        return f"({self.x(n.x)} {'NOT ' if n.negated else ''}BETWEEN {self.x(n.low)} AND {self.x(n.high)})"

    def x_like(self, n):
        if n.op == "similar":
            raise SqlError("SIMILAR TO has no Spark form")
        return f"({self.x(n.x)} {'NOT ' if n.negated else ''}{n.op.upper()} {self.x(n.pattern)})"

    def x_quantified(self, n):
        if n.right.kind == "array" and (n.op, n.quantifier) in (("=", "any"), ("=", "some")):
            return f"({self.x(n.left)} IN ({', '.join(map(self.x, n.right.items))}))"
        if n.right.kind == "array" and n.op in ("<>", "!=") and n.quantifier == "all":
            return f"({self.x(n.left)} NOT IN ({', '.join(map(self.x, n.right.items))}))"
        if n.right.kind == "subquery" and (n.op, n.quantifier) in (("=", "any"), ("=", "some")):
            return f"({self.x(n.left)} IN ({self.query(n.right.query)}))"
        if n.op == "=" and n.quantifier in ("any", "some"):
            return f"array_contains({self.x(n.right)}, {self.x(n.left)})"
        raise SqlError(f"no Spark form of {n.op} {n.quantifier}")

    def x_case(self, n):
        operand = f" {self.x(n.operand)}" if n.operand is not None else ""
        other = f" ELSE {self.x(n.other)}" if n.other is not None else ""
        return f"CASE{operand} {' '.join(f'WHEN {self.x(c)} THEN {self.x(v)}' for c, v in n.whens)}{other} END"

    def x_array(self, n):
        return f"array({', '.join(map(self.x, n.items))})"

    def x_row(self, n):
        return f"({', '.join(map(self.x, n.items))})"

    def x_index(self, n):
        return f"element_at({self.x(n.x)}, {self.x(n.at)})"

    def x_extract(self, n):
        if n.field == "epoch":
            return f"(unix_micros(CAST({self.x(n.x)} AS TIMESTAMP)) / 1e6)"
        if n.field == "dow":
            return f"(extract(DOW FROM {self.x(n.x)}) - 1)"
        return f"extract({n.field.upper()} FROM {self.x(n.x)})"

    def x_grouping(self, n):
        return f"{'GROUPING SETS' if n.type == 'sets' else n.type.upper()} ({', '.join(self.x(i) if i.kind == 'row' or n.type != 'sets' else '(' + self.x(i) + ')' for i in n.items)})"

    def x_call(self, n):
        if self.now and _is_now(n):
            kind = "DATE" if n.name == "current_date" else "TIMESTAMP_NTZ"
            return f"CAST({_string(self.now)} AS {kind})"
        if n.bare:
            return f"{n.name}()"
        args = [self.x(a) for a in n.args if a.kind != "named"]
        if n.name == "make_interval":
            return f"make_dt_interval(0, 0, 0, {parse_interval(_interval_text(n)) / 1e6!r})"
        if n.name == "date_trunc" and len(args) == 2:
            text = f"CAST(date_trunc({args[0]}, {args[1]}) AS TIMESTAMP_NTZ)"
        elif n.name in ("json_agg", "jsonb_agg"):
            text = f"to_json({self.ordered(n, args[0])})"
        elif n.name == "array_agg":
            text = self.ordered(n, args[0])
        elif n.name == "string_agg":
            text = f"array_join({self.ordered(n, args[0])}, {args[1]})"
        elif n.name == "array_replace":
            text = f"transform({args[0]}, v -> CASE WHEN v IS NOT DISTINCT FROM {args[1]} THEN {args[2]} ELSE v END)"
        elif n.name == "array_prepend":
            text = f"array_prepend({args[1]}, {args[0]})"
        elif n.name in ("array_length", "array_upper"):
            text = f"nullif(size({args[0]}), 0)"
        elif n.name == "array_lower":
            text = f"CASE WHEN size({args[0]}) > 0 THEN 1 END"
        elif n.name == "array_dims":
            text = f"CASE WHEN size({args[0]}) > 0 THEN concat('[1:', size({args[0]}), ']') END"
        else:
            text = f"{FUNCTIONS.get(n.name, n.name)}({'DISTINCT ' if n.distinct else ''}{', '.join(args)})"
        if n.filter is not None:
            text += f" FILTER (WHERE {self.x(n.filter)})"
        return text + (f" OVER {_name(n.over.ref) if n.over.ref and not (n.over.partition or n.over.order) else self.window(n.over)}" if n.over else "")

    def ordered(self, n: Node, value: str) -> str:
        """An aggregate's values as an array, in its ORDER BY's order."""
        call = "collect_set" if n.distinct else "collect_list"
        if not n.order:
            return f"array_sort({call}({value}))" if n.distinct else f"{call}({value})"
        keys = [self.x(o.expr) for o in n.order]
        fields = ", ".join(f"{k} AS k{i}" for i, k in enumerate(keys))
        turns = " ".join(f"WHEN a.k{i} < b.k{i} THEN {1 if o.desc else -1} WHEN a.k{i} > b.k{i} THEN {-1 if o.desc else 1}" for i, o in enumerate(n.order))
        return f"transform(array_sort({call}(struct({fields}, {value} AS v)), (a, b) -> CASE {turns} ELSE 0 END), s -> s.v)"
