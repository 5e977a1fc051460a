"""Structured query plans: what to ask of a dataset as a row of a table, checked against the catalog and run together.

A plan names a dataset, a mode, columns, filters, aggregates, groups, an order and a limit.  Checking is
one plan over all of them and gives reasons, never an exception.  Good plans become expressions over
their table, and plans of equal shape are answered in one pass (``operators.shared_scan``).
"""

from __future__ import annotations

from itertools import batched

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabquest import fixed_values as fv
from tabquest.operators import shared_scan
from tabquest.session import small_table, work_dir

PLAN_SCHEMA = (
    "dataset string, mode string, columns array<string>, "
    "filters array<struct<column:string,op:string,values:array<string>>>, "
    "aggregation array<struct<function:string,column:string,name:string>>, group_by array<string>, "
    "order_by array<struct<name:string,descending:boolean>>, limit int"
)
MODES = ("full", "filtered", "aggregation", "top_n")
# How many values an operator takes; null for any number from one on.
OPERATORS = {"=": 1, "<>": 1, "<": 1, "<=": 1, ">": 1, ">=": 1, "in": None, "between": 2, "like": 1, "is null": 0, "is not null": 0}
FUNCTIONS = ("count", "count_distinct", "sum", "avg", "min", "max")
NUMERIC_ONLY = ("sum", "avg")
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _is_number(kind: Column) -> Column:
    return kind.isin(*_NUMBERS) | kind.startswith("decimal")


def _readable(value: Column, kind: Column) -> Column:
    """Whether a text can be read as a value of a type; only simple types can be compared."""
    return (
        F.when(kind == "string", F.lit(True))
        .when(kind.isin("tinyint", "smallint", "int", "bigint"), value.try_cast("bigint").isNotNull())
        .when(_is_number(kind), value.try_cast("double").isNotNull())
        .when(kind == "boolean", value.try_cast("boolean").isNotNull())
        .when(kind == "date", value.try_cast("date").isNotNull())
        .when(kind.startswith("timestamp"), value.try_cast("timestamp_ntz").isNotNull())
        .otherwise(F.lit(False))
    )


def _each(rows: Column, reason) -> Column:
    """Reasons given for the elements of a list, without nulls; a null list has none."""
    return F.coalesce(F.array_compact(F.transform(rows, reason)), F.array().cast("array<string>"))


def _one(condition: Column, text: Column) -> Column:
    return F.when(condition, F.array(text)).otherwise(F.array().cast("array<string>"))


def plan_problems(plan: Column, types: Column) -> Column:
    """Reasons why a plan cannot be run, in a fixed order; ``types`` maps the dataset's columns to types, null if it is unknown."""
    kind = lambda c: F.try_element_at(types, F.coalesce(c, F.lit("")))
    unknown = lambda c: F.when(kind(c).isNull(), F.concat(F.lit("unknown column: "), F.coalesce(c, F.lit("null"))))
    columns, filters, aggregation = plan["columns"], plan["filters"], plan["aggregation"]
    group_by, order_by = plan["group_by"], plan["order_by"]
    has = lambda rows: F.coalesce(F.size(rows) > 0, F.lit(False))
    counts = F.create_map(*[F.lit(x) for op, n in OPERATORS.items() for x in (op, -1 if n is None else n)])

    def filter_reason(f: Column) -> Column:
        wanted, given = F.try_element_at(counts, F.coalesce(F.lower(f["op"]), F.lit(""))), F.coalesce(F.size(f["values"]), F.lit(0))
        named = F.concat(F.coalesce(f["column"], F.lit("null")), F.lit(" "), F.coalesce(f["op"], F.lit("null")))
        bad = F.exists(f["values"], lambda v: v.isNull() | ~F.coalesce(_readable(v, kind(f["column"])), F.lit(False)))
        return (
            F.when(kind(f["column"]).isNull(), unknown(f["column"]))
            .when(wanted.isNull(), F.concat(F.lit("unknown operator: "), named))
            .when((wanted >= 0) & (given != wanted) | (wanted < 0) & (given == 0), F.concat(F.lit("wrong number of values: "), named))
            .when((F.lower(f["op"]) == "like") & (kind(f["column"]) != "string"), F.concat(F.lit("not a text column: "), named))
            .when(bad, F.concat(F.lit("value of another type: "), named))
        )

    def aggregate_reason(a: Column) -> Column:
        of_all = (a["function"] == "count") & (F.coalesce(a["column"], F.lit("*")) == "*")
        return (
            F.when(~F.coalesce(a["function"].isin(*FUNCTIONS), F.lit(False)), F.concat(F.lit("unknown function: "), F.coalesce(a["function"], F.lit("null"))))
            .when(~of_all & kind(a["column"]).isNull(), unknown(a["column"]))
            .when(a["function"].isin(*NUMERIC_ONLY) & ~_is_number(kind(a["column"])), F.concat(F.lit("not a numeric column: "), a["column"]))
            .when(F.coalesce(a["name"], F.lit("")) == "", F.lit("aggregate without a name"))
        )

    names = F.concat(F.coalesce(group_by, F.array().cast("array<string>")), F.coalesce(F.transform(aggregation, lambda a: a["name"]), F.array().cast("array<string>")))
    lowered = F.transform(names, lambda n: F.lower(n))
    sortable = F.when(has(aggregation), names).otherwise(F.map_keys(types))
    found = F.concat(
        _one(~F.coalesce(plan["mode"].isin(*MODES), F.lit(False)), F.concat(F.lit("unknown mode: "), F.coalesce(plan["mode"], F.lit("null")))),
        _each(columns, unknown),
        _each(filters, filter_reason),
        _each(aggregation, aggregate_reason),
        _each(group_by, unknown),
        _one(has(aggregation) & (F.size(F.array_distinct(lowered)) < F.size(lowered)), F.lit("two results of one name")),
        _each(order_by, lambda o: F.when(~F.coalesce(F.array_contains(sortable, o["name"]), F.lit(False)), F.concat(F.lit("cannot sort by: "), F.coalesce(o["name"], F.lit("null"))))),
        _one(F.coalesce(plan["limit"] < 1, F.lit(False)), F.lit("limit below one")),
        _one((plan["mode"] == "filtered") & ~has(filters), F.lit("filtered without a filter")),
        _one((plan["mode"] == "aggregation") & ~has(aggregation), F.lit("aggregation without an aggregate")),
        _one(has(group_by) & ~has(aggregation), F.lit("groups without an aggregate")),
        _one(has(aggregation) & has(columns), F.lit("columns beside aggregates belong to group_by")),
        _one((plan["mode"] == "top_n") & (~has(order_by) | plan["limit"].isNull()), F.lit("top_n without an order or a limit")),
    )
    return F.when(plan.isNull(), F.array(F.lit("no plan"))).when(
        types.isNull(), F.array(F.concat(F.lit("unknown dataset: "), F.coalesce(plan["dataset"], F.lit("null"))))
    ).otherwise(found)


def check_plans(plans: DataFrame, catalog: DataFrame) -> DataFrame:
    """``plans`` (plan_id, plan) with ``problems`` and ``types`` of the dataset's columns.

    ``catalog`` has table_name, column_name and data_type; a dataset is named by its table, in any case.
    """
    entry = F.struct("column_name", F.lower("data_type").alias("data_type"))
    known = catalog.groupBy(F.lower("table_name").alias("known")).agg(
        F.first("table_name").alias("table_name"), F.map_from_entries(F.collect_list(entry)).alias("types")
    )
    joined = plans.join(known, F.lower(F.col("plan.dataset")) == F.col("known"), "left")
    return joined.select("plan_id", "plan", "table_name", "types", plan_problems(F.col("plan"), F.col("types")).alias("problems"))


# ---- from a plan to expressions ----------------------------------------------------


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _value(text: str, kind: str) -> str:
    quoted = "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return quoted if kind == "string" else f"CAST({quoted} AS {kind})"


def _condition(f, types: dict[str, str]) -> str:
    column, op, kind = _name(f["column"]), f["op"].lower(), types[f["column"]]
    values = [_value(v, kind) for v in f["values"] or []]
    if op == "in":
        return f"{column} IN ({', '.join(values)})"
    if op == "between":
        return f"{column} BETWEEN {values[0]} AND {values[1]}"
    return f"{column} {op.upper()} {' '.join(values)}".rstrip()


def _aggregate(a) -> str:
    if a["function"] == "count_distinct":
        return f"count(DISTINCT {_name(a['column'])})"
    return f"{a['function']}({'*' if (a['column'] or '*') == '*' else _name(a['column'])})"


def clauses_of_plan(plan, types: dict[str, str], table: str) -> shared_scan.Clauses:
    """The expressions that a plan without problems stands for."""
    group = tuple(_name(g) for g in plan["group_by"] or [])
    aggregates = {a["name"]: _aggregate(a) for a in plan["aggregation"] or []}
    if aggregates:
        items = [(g, None) for g in group] + [(text, name) for name, text in aggregates.items()]
    else:
        items = [(_name(c), None) for c in plan["columns"] or []] or [("*", None)]
    order = [(aggregates.get(o["name"], _name(o["name"])), bool(o["descending"]), not o["descending"]) for o in plan["order_by"] or []]
    where = " AND ".join(f"({_condition(f, types)})" for f in plan["filters"] or []) or None
    return shared_scan.Clauses(table, tuple(items), where, group, None, tuple(order), plan["limit"])


def _text(c: shared_scan.Clauses) -> str:
    named = ", ".join(text if alias is None else f"{text} AS {_name(alias)}" for text, alias in c.items)
    return f"SELECT {named} FROM {c.table}" + (f" WHERE {c.where}" if c.where else "") + (f" GROUP BY {', '.join(c.group)}" if c.group else "")


def run_plans(spark: SparkSession, checked: DataFrame, limit: int = fv.DEFAULT_ROW_LIMIT) -> DataFrame:
    """plan_id, position and record of every plan without problems, read from written tables.

    ``checked`` comes from :func:`check_plans`.  The driver walks distinct plans, a thousand at a time, and
    turns them into a few jobs; each plan has at most ``limit`` records, and at most its own limit.
    """
    folder = work_dir(spark, "plans")
    schema = "query string, position long, record string"
    small_table(spark, [], schema).write.parquet(f"{folder}/job=none")
    key = F.concat(F.lit("p"), F.sha2(F.to_json(F.struct("plan")), 256)).alias("query")
    good = checked.where(F.size("problems") == 0).select("plan_id", key, "plan", "types", "table_name")
    distinct = good.drop("plan_id").dropDuplicates(["query"])
    for number, rows in enumerate(batched(distinct.toLocalIterator(), 1000), start=1):
        queries = []
        for row in rows:
            clauses = clauses_of_plan(row["plan"], row["types"], row["table_name"])
            queries.append(shared_scan.Query(row["query"], clauses, spark.sql(_text(clauses)).schema))
        for i, (_, found) in enumerate(shared_scan.passes(spark, queries, limit)):
            found.write.mode("overwrite").parquet(f"{folder}/job={number}-{i}")
    answers = spark.read.schema(schema).parquet(folder).select("query", "position", "record")
    return good.select("plan_id", "query").join(answers, "query").drop("query")
