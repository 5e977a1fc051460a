"""Joins along allowed relationships: a table of which columns may be joined, shortest paths, and the joined rows.

A relationship names two columns that may be equated.  Paths are found for all requests together by
rounds of joins from the tables reached last; a path never joins anything that no relationship allows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabquest.session import materialise

RELATIONSHIP_SCHEMA = "left_table string, left_column string, right_table string, right_column string"
# Relationships that a path may have.
MAX_STEPS = 8
MSG_NO_PATH = "no allowed relationship leads from {0} to {1}"
# A filter on one side of a large join goes to the other side's scan as a Bloom filter, whatever that side's size.
BLOOM_SETTINGS = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
}


def join_paths(requests: DataFrame, relationships: DataFrame, max_steps: int = MAX_STEPS) -> DataFrame:
    """``requests`` (request_id, start_table, end_table) with ``path`` and ``problem``.

    A path is a list of steps (left_table, left_column, right_table, right_column), each leading on from the
    table before; the shortest one counts, of equal ones the first in order.  It is empty where start and
    end are the same, and null, with a problem, where no path of ``max_steps`` leads there.
    """
    names = ("left_table", "left_column", "right_table", "right_column")
    turned = relationships.select(*[F.col(b).alias(a) for a, b in zip(names, (*names[2:], *names[:2]))])
    steps = relationships.select(*names).unionByName(turned).where("left_table <> right_table").distinct()
    steps = materialise(steps.select(F.col("left_table").alias("at"), F.struct(*names).alias("step")), "steps")
    nowhere = F.array().cast(f"array<struct<{RELATIONSHIP_SCHEMA.replace(' string', ':string')}>>")
    starts = requests.where("start_table IS NOT NULL").select(F.col("start_table").alias("start")).distinct()
    reached = frontier = materialise(starts.select("start", F.col("start").alias("at"), nowhere.alias("path")), "reached")
    for _ in range(max_steps):
        on = frontier.join(steps, "at").select("start", F.col("step.right_table").alias("at"), F.concat("path", F.array("step")).alias("path"))
        new = on.groupBy("start", "at").agg(F.min("path").alias("path")).join(reached, ["start", "at"], "left_anti")
        frontier = materialise(new, "frontier")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    ends = reached.select(F.col("start").alias("start_table"), F.col("at").alias("end_table"), "path")
    missing = F.format_string(MSG_NO_PATH.replace("{0}", "%s").replace("{1}", "%s"), F.coalesce("start_table", F.lit("null")), F.coalesce("end_table", F.lit("null")))
    return requests.join(ends, ["start_table", "end_table"], "left").select(
        "request_id", "start_table", "end_table", "path", F.when(F.col("path").isNull(), missing).alias("problem")
    )


def path_text(path: Column) -> Column:
    """Steps as ``table.column=table.column`` joined by bars."""
    step = lambda s: F.concat(s["left_table"], F.lit("."), s["left_column"], F.lit("="), s["right_table"], F.lit("."), s["right_column"])
    return F.array_join(F.transform(path, step), "|")


def qualified(df: DataFrame, table: str) -> DataFrame:
    """Columns named ``table.column``, so that those of several tables do not clash."""
    return df.select(*[F.col(f"`{c}`").alias(f"{table}.{c}") for c in df.columns])


def join_along(tables: Mapping[str, DataFrame], start: str, path: list, filters: Mapping[str, str] | None = None) -> DataFrame:
    """Inner joins of the tables on a path; ``filters`` gives conditions, in each table's own names, that hold before its join."""
    filters = filters or {}
    unknown = set(filters) - {start, *(s["right_table"] for s in path)}
    if unknown:
        raise ValueError(f"filter on a table that is not on the path: {', '.join(sorted(unknown))}")

    def rows(name: str) -> DataFrame:
        df = tables[name]
        return qualified(df.where(filters[name]) if name in filters else df, name)

    joined = rows(start)
    for s in path:
        left, right = (F.col(f"`{s[f'{side}_table']}.{s[f'{side}_column']}`") for side in ("left", "right"))
        joined = joined.join(rows(s["right_table"]), left == right)
    return joined


@contextmanager
def bloom_filters(spark: SparkSession) -> Iterator[None]:
    """Let Spark build Bloom filters from filtered sides while queries are planned; settings are put back."""
    before = {setting: spark.conf.get(setting) for setting in BLOOM_SETTINGS}
    for setting, value in BLOOM_SETTINGS.items():
        spark.conf.set(setting, value)
    try:
        yield
    finally:
        for setting, value in before.items():
            spark.conf.set(setting, value)


def joined_answer(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    relationships: DataFrame,
    start: str,
    end: str,
    group_by: Mapping[str, str],
    aggregates: Mapping[str, Column],
    filters: Mapping[str, str] | None = None,
) -> DataFrame:
    """Aggregates per group over the tables between ``start`` and ``end``, read from a written table.

    ``group_by`` maps result names to ``table.column``; ``aggregates`` are over columns of that form.
    Raises ``ValueError`` where no allowed relationship leads from one table to the other.
    """
    request = spark.createDataFrame([(0, start, end)], "request_id int, start_table string, end_table string")
    row = join_paths(request, relationships).first()
    if row["problem"]:
        raise ValueError(row["problem"])
    joined = join_along(tables, start, row["path"], filters)
    groups = [F.col(f"`{column}`").alias(name) for name, column in group_by.items()]
    with bloom_filters(spark):
        return materialise(joined.groupBy(*groups).agg(*[a.alias(n) for n, a in aggregates.items()]), "joined-answer")
