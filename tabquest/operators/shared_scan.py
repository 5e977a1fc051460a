"""Answers of many single-table queries from few scans of their table.

A query is given by its clauses.  Queries of one table that group and sort alike (they have the same
shape) are answered in one pass: every query's filter becomes a condition on the row, its aggregates are
filtered aggregates, and its records carry its tag.  Each query keeps its first rows per task
before records are shuffled, so no query brings a whole table together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabquest.session import batched_by

# Queries that one pass answers; more make further passes over the table.
QUERIES_PER_PASS = 100
# Passes that one job runs.
PASSES_PER_JOB = 4

# Functions that aggregate, words that only other kinds of queries have.
AGGREGATES = (
    "count", "sum", "avg", "mean", "min", "max", "stddev", "stddev_samp", "stddev_pop", "variance", "var_samp", "var_pop",
    "median", "count_if", "bool_and", "bool_or", "every", "any", "some",
)
_OTHER_KINDS = r"(?i)\b(?:select\b.*\bselect|union|intersect|except|over|filter|window|offset|qualify|lateral|pivot|rollup|cube|grouping|using|tablesample)\b|^\s*select\s+(?:distinct|all)\b|/\*|--"
_CLAUSES = re.compile(
    r"\s*select\s+(?P<items>.+?)\s+from\s+(?P<table>\"[^\"]+\"|`[^`]+`|\w+)(?:\s+where\s+(?P<where>.+?))?(?:\s+group\s+by\s+(?P<group>.+?))?"
    r"(?:\s+having\s+(?P<having>.+?))?(?:\s+order\s+by\s+(?P<order>.+?))?(?:\s+limit\s+(?P<limit>\d+))?\s*",
    re.I | re.S,
)
_ALIAS = re.compile(r"(?P<expr>.+?)\s+as\s+(?P<name>\w+|\"[^\"]+\"|`[^`]+`)\s*", re.I | re.S)
_ORDER = re.compile(r"(?P<expr>.+?)(?:\s+(?P<way>asc|desc))?(?:\s+nulls\s+(?P<nulls>first|last))?\s*", re.I | re.S)
_QUOTED = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`")
_CALL = re.compile(r"\b(?:" + "|".join(AGGREGATES) + r")\s*\(", re.I)
_SIMPLE = (T.NumericType, T.BooleanType, T.StringType, T.ArrayType, T.StructType, T.MapType)


@dataclass(frozen=True)
class Clauses:
    """One query over one table; every part is an expression in SQL."""

    table: str
    items: tuple[tuple[str, str | None], ...]  # expression and alias
    where: str | None = None
    group: tuple[str, ...] = ()
    having: str | None = None
    order: tuple[tuple[str, bool, bool], ...] = ()  # expression, descending, nulls first
    limit: int | None = None

    @property
    def aggregates(self) -> bool:
        return bool(self.group) or any(_CALL.search(_masked(text)) for text, _ in self.items)


@dataclass
class Query:
    """A query with its tag and the columns it gives."""

    tag: str
    clauses: Clauses
    schema: T.StructType
    problem: str | None = field(default=None)


# ---- clauses of a text -------------------------------------------------------------


def _masked(text: str) -> str:
    """The text with everything within quotes blotted out, place by place."""
    return _QUOTED.sub(lambda m: m.group()[0] + "\x00" * (len(m.group()) - 2) + m.group()[-1], text)


def _listed(text: str) -> list[str]:
    """Parts between commas outside of brackets and quotes."""
    parts, depth, first = [], 0, 0
    masked = _masked(text)
    for i, c in enumerate(masked):
        depth += (c in "([") - (c in ")]")
        if c == "," and not depth:
            parts.append(text[first:i].strip())
            first = i + 1
    return [*parts, text[first:].strip()]


def _bare(name: str) -> str:
    return name[1:-1] if name[0] in '"`' else name


def clauses_of(sql: str) -> Clauses | None:
    """Clauses of a plain single-table SELECT; None for any other text, which then runs by itself."""
    masked = _masked(sql)
    found = _CLAUSES.fullmatch(masked)
    if not found or re.search(_OTHER_KINDS, masked, re.S):
        return None
    part = {name: sql[slice(*found.span(name))] if found.group(name) is not None else None for name in found.groupdict()}
    items = []
    for text in _listed(part["items"]):
        named = _ALIAS.fullmatch(_masked(text))
        items.append((text[: named.end("expr")], _bare(text[slice(*named.span("name"))])) if named else (text, None))
    named = {alias.lower(): text for text, alias in items if alias}

    def resolved(text: str) -> str:
        if text.isdigit():
            return items[int(text) - 1][0] if 0 < int(text) <= len(items) else text
        return named.get(_bare(text).lower(), text)

    order = []
    for text in _listed(part["order"]) if part["order"] else []:
        one = _ORDER.fullmatch(_masked(text))
        descending = (one["way"] or "").lower() == "desc"
        nulls_first = one["nulls"].lower() == "first" if one["nulls"] else not descending
        order.append((resolved(text[: one.end("expr")]), descending, nulls_first))
    return Clauses(
        table=_bare(part["table"]),
        items=tuple(items),
        where=part["where"],
        group=tuple(resolved(g) for g in _listed(part["group"])) if part["group"] else (),
        having=part["having"],
        order=tuple(order),
        limit=int(part["limit"]) if part["limit"] else None,
    )


def with_filter(text: str, condition: str | None) -> str:
    """An expression whose aggregates look only at rows that meet a condition."""
    if condition is None:
        return text
    masked, out, at = _masked(text), "", 0
    for call in _CALL.finditer(masked):
        depth = 0
        for end in range(call.end() - 1, len(masked)):
            depth += (masked[end] == "(") - (masked[end] == ")")
            if not depth:
                break
        out += text[at : end + 1] + f" FILTER (WHERE {condition})"
        at = end + 1
    return out + text[at:]


# ---- one pass ------------------------------------------------------------------------


def _items(query: Query, base: DataFrame) -> list[str]:
    """Expressions of the query's columns; a star stands for all columns."""
    found = []
    for text, _ in query.clauses.items:
        found += [f"`{c}`" for c in base.columns] if text == "*" else [text]
    return found


def _record(values: list[Column], schema: T.StructType) -> Column:
    shown = [
        (v if isinstance(f.dataType, _SIMPLE) else v.cast("string")).alias(f.name) for v, f in zip(values, schema.fields)
    ]
    return F.to_json(F.struct(*shown), {"ignoreNullFields": "false"})


def _sorted(names: list[str], order: tuple) -> list[Column]:
    ways = {(False, True): "asc_nulls_first", (False, False): "asc_nulls_last", (True, True): "desc_nulls_first", (True, False): "desc_nulls_last"}
    return [getattr(F.col(n), ways[(descending, first)])() for n, (_, descending, first) in zip(names, order)]


def shape_of(query: Query) -> tuple:
    """Queries of equal shape are answered together."""
    c = query.clauses
    return c.table, c.aggregates, c.group, c.order


def _tagged(rows: DataFrame, queries: list[Query], met: list[Column], values: list[list[Column]], keys: list[list[Column]]) -> DataFrame:
    """A row per query that a row meets: tag, record, sort keys."""
    tags = [
        F.when(
            condition,
            F.struct(F.lit(q.tag).alias("query"), _record(own, q.schema).alias("record"), *[k.alias(f"key{i}") for i, k in enumerate(sort_keys)]),
        )
        for q, condition, own, sort_keys in zip(queries, met, values, keys)
    ]
    return rows.select("place", F.inline(F.array_compact(F.array(*tags))))


def one_pass(base: DataFrame, queries: list[Query], most: int) -> DataFrame:
    """query, position and record of all ``queries``, which have one shape; each has at most ``most`` records."""
    first = queries[0].clauses
    conditions = [q.clauses.where for q in queries]
    if not first.aggregates:
        rows = base.withColumn("place", F.monotonically_increasing_id())
        met = [F.expr(c) if c else F.lit(True) for c in conditions]
        values = [[F.expr(text) for text in _items(q, base)] for q in queries]
        keys = [[F.expr(text) for text, _, _ in q.clauses.order] for q in queries]
    else:
        columns, met, values, keys = [], [], [], []
        for i, (q, condition) in enumerate(zip(queries, conditions)):
            texts = {"v": [text for text, _ in q.clauses.items], "k": [text for text, _, _ in q.clauses.order], "h": [q.clauses.having] if q.clauses.having else []}
            named = {kind: [f"q{i}_{kind}{j}" for j in range(len(own))] for kind, own in texts.items()}
            columns += [F.expr(with_filter(text, condition)).alias(n) for kind in texts for text, n in zip(texts[kind], named[kind])]
            columns.append(F.expr(with_filter("count(*)", condition)).alias(f"q{i}_n"))
            present = F.col(f"q{i}_n") > 0 if first.group else F.lit(True)
            met.append(present & F.col(named["h"][0]) if named["h"] else present)
            values.append([F.col(n) for n in named["v"]])
            keys.append([F.col(n) for n in named["k"]])
        grouped = base.groupBy(*[F.expr(g).alias(f"group{i}") for i, g in enumerate(first.group)]).agg(*columns)
        rows = grouped.withColumn("place", F.lit(0).cast("long") if not first.group else F.monotonically_increasing_id())
    found = _tagged(rows, queries, met, values, keys)
    order = [*_sorted([f"key{i}" for i in range(len(first.order))], first.order), "place"]
    limits = {q.tag: most if q.clauses.limit is None else min(most, q.clauses.limit) for q in queries}
    numbered = found.withColumn("position", F.row_number().over(Window.partitionBy("query").orderBy(*order)))
    kept = numbered.where(F.col("position") <= most)  # each task drops what is beyond before the shuffle
    if set(limits.values()) != {most}:
        own = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
        kept = kept.where(F.col("position") <= own[F.col("query")])
    return kept.select("query", F.col("position").cast("long").alias("position"), "record")


def compiled(spark: SparkSession, query: Query) -> bool:
    """Whether a pass of this query alone gives the columns that Spark finds in its text."""
    try:
        base = spark.table(query.clauses.table)
        names = [f.name for f in query.schema.fields]
        if len(set(n.lower() for n in names)) < len(names) or len(_items(query, base)) != len(names):
            return False
        texts = [F.expr(text) for text in _items(query, base)]
        if query.clauses.aggregates:
            own = base.groupBy(*[F.expr(g) for g in query.clauses.group]).agg(*texts).schema.fields[len(query.clauses.group) :]
        else:
            own = base.select(*texts).schema.fields
        one_pass(base, [query], 1)
        return [f.dataType for f in own] == [f.dataType for f in query.schema.fields]
    except (AnalysisException, ParseException):
        return False


def passes(spark: SparkSession, queries: list[Query], most: int) -> Iterator[tuple[list[Query], DataFrame]]:
    """Jobs of a few passes each, and the queries that they answer."""
    by_shape: dict[tuple, list[Query]] = {}
    for q in queries:
        by_shape.setdefault(shape_of(q), []).append(q)
    groups = [g for own in by_shape.values() for g in batched_by(own, QUERIES_PER_PASS)]
    for together in batched_by(groups, PASSES_PER_JOB):
        frames = [one_pass(spark.table(g[0].clauses.table), list(g), most) for g in together]
        whole = frames[0]
        for more in frames[1:]:
            whole = whole.unionByName(more)
        yield [q for g in together for q in g], whole
