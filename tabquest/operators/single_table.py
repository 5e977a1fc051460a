"""Single-table query operators: filters, lookups, grouped and wide aggregates, top-N."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabquest import fixed_values as fv


def flags_set(*columns: str) -> Column:
    """True where every 0/1 flag column is 1."""
    wanted = F.lit(True)
    for name in columns:
        wanted = wanted & (F.col(name) == 1)
    return wanted


def either_column(first: str, second: str, value) -> Column:
    """Match a value in either half of an unordered pair."""
    return (F.col(first) == value) | (F.col(second) == value)


def unordered_pair(first: str, second: str) -> list[Column]:
    """The pair in canonical order, as columns ``pair_low`` and ``pair_high``."""
    return [
        F.least(F.col(first), F.col(second)).alias("pair_low"),
        F.greatest(F.col(first), F.col(second)).alias("pair_high"),
    ]


def list_members(text: Column, separator: str = ",") -> Column:
    """Members of a list stored as text, stripped."""
    return F.transform(F.split(text, f"[{separator}]"), lambda m: F.trim(m))


def has_member(text: Column, member: str, separator: str = ",") -> Column:
    return F.array_contains(list_members(text, separator), member)


def distribution(df: DataFrame, *keys: str) -> DataFrame:
    """Rows per value and their percentage of all rows.

    One row per group and task is shuffled; the total is a scalar subquery that
    needs no column of the input.
    """
    total = df.select(F.count("*")).scalar()
    counts = df.groupBy(*keys).agg(F.count("*").alias("row_count"))
    return counts.withColumn("percentage", F.round(100.0 * F.col("row_count") / total, 3))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def column_averages(df: DataFrame, columns: Iterable[str] | None = None, digits: int = 4) -> DataFrame:
    """Average of every numeric column in one pass, one output row per column."""
    names = list(columns or numeric_columns(df))
    wide = df.agg(*[F.avg(F.col(f"`{n}`")).alias(f"v{i}") for i, n in enumerate(names)])
    pairs = F.array(
        *[
            F.struct(F.lit(n).alias("column_name"), F.round(F.col(f"v{i}"), digits).alias("average"))
            for i, n in enumerate(names)
        ]
    )
    return wide.select(F.explode(pairs).alias("p")).select("p.column_name", "p.average")


def flag_prevalence(df: DataFrame, entity: str, value: str, values: Iterable[str]) -> DataFrame:
    """Share of entities for which each value occurs at all."""
    names = list(values)
    flags = df.groupBy(entity).agg(
        *[F.max(F.when(F.col(value) == n, 1).otherwise(0)).alias(f"f{i}") for i, n in enumerate(names)]
    )
    wide = flags.agg(
        F.count("*").alias("n"), *[F.sum(f"f{i}").alias(f"s{i}") for i in range(len(names))]
    )
    pairs = F.array(
        *[
            F.struct(
                F.lit(n).alias("flag"),
                F.col(f"s{i}").alias("with_flag"),
                F.round(F.col(f"s{i}") / F.col("n"), 6).alias("prevalence"),
            )
            for i, n in enumerate(names)
        ]
    )
    return wide.select(F.explode(pairs).alias("p")).select("p.flag", "p.with_flag", "p.prevalence")


def top_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows of an order; each task keeps only ``n`` rows."""
    return df.orderBy(*order).limit(n)


def result_records(df: DataFrame, limit: int = fv.DEFAULT_ROW_LIMIT) -> DataFrame:
    """Capped result as JSON text, one row per record, values that JSON lacks as text."""
    simple = (T.NumericType, T.BooleanType, T.StringType, T.ArrayType, T.StructType, T.MapType)
    shown = [
        F.col(f"`{f.name}`") if isinstance(f.dataType, simple) else F.col(f"`{f.name}`").cast("string").alias(f.name)
        for f in df.schema.fields
    ]
    return df.limit(limit).select(F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("record"))


def result_summary(df: DataFrame, limit: int = fv.DEFAULT_ROW_LIMIT) -> DataFrame:
    """One row for a capped result: columns, rows, row_count_returned, limit_applied, is_truncated.

    The query runs once; it gives at most one row more than the cap, which tells that there are more.
    """
    found = result_records(df, limit + 1).withColumn("position", F.monotonically_increasing_id())
    records = F.transform(F.array_sort(F.collect_list(F.struct("position", "record"))), lambda r: r["record"])
    return found.agg(records.alias("records")).select(
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        F.slice("records", 1, limit).alias("rows"),
        F.least(F.size("records"), F.lit(limit)).cast("long").alias("row_count_returned"),
        F.lit(limit).cast("long").alias("limit_applied"),
        (F.size("records") > limit).alias("is_truncated"),
    )


def is_truncated(df: DataFrame, limit: int = fv.DEFAULT_ROW_LIMIT) -> bool:
    """Whether a result has more rows than the cap shows; reads at most one row more."""
    return df.limit(limit + 1).count() > limit
