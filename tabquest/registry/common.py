"""What the registered queries share: the given tables, a manifest of them, derived questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabquest import fixed_values as fv
from tabquest.session import configure, small_table
from tabquest.sources.manifest import FIELDS
from tabquest.sources.tables import catalog_of

# The given tables with their columns and Spark types.
GIVEN = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
TABLES = tuple(GIVEN)
COLUMNS = {t: [tuple(c.strip().split(" ", 1)) for c in spec.split(", ")] for t, spec in GIVEN.items()}

# Texts of the manifest that describes the given tables.
DESCRIPTIONS = {
    "customer": "Customers with their nation, account balance and market segment.",
    "orders": "Orders of customers with status, total price, order date and priority.",
    "lineitem": "Line items of orders with quantity, price, discount, tax and ship date.",
    "part": "Parts with name, brand, type, size and retail price.",
    "events": "User events with type, time and value.",
    "documents": "Text documents in several languages.",
}
NOTES = {
    "labels": "quality and toxic are 0/1 flags; 0 is an explicit negative.",
    "part": "p_name combines two words; match by word, not by the full value.",
    "events": "props is JSON stored as text.",
}
SOURCES = {"lineitem": "warehouse", "orders": "warehouse", "pages": "crawl"}
DOMAINS = {"lineitem": "sales, logistics", "part": "catalog", "pages": "web"}


def registrar(queries: dict, oracles: dict):
    """A decorator that lists a query under a name, next to the SQL it is compared with."""

    def register(name: str, sql: str):
        def add(query):
            queries[name], oracles[name] = query, sql
            return query

        return add

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read with its known schema, so that no job looks for it first."""
    return configure(spark).read.schema(GIVEN[name]).parquet(f"{sf_dir}/{name}.parquet")


def found_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The given tables with the schemas their files declare."""
    return {name: configure(spark).read.parquet(f"{sf_dir}/{name}.parquet") for name in TABLES}


def given_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: table(spark, sf_dir, name) for name in TABLES}


def file_path(name: str) -> str:
    return f"data/{name}.csv"


def manifest_rows() -> list[tuple]:
    """Entries that name their table in three ways: explicitly, by dataset name, by file."""
    rows = []
    for i, name in enumerate(TABLES):
        rows.append(
            {
                "manifest_file": "",
                "entry_pos": i,
                "file_path": file_path(name),
                "metadata_path": f"metadata/{name}.json",
                "dataset_name": "" if i % 3 == 2 else name.title(),
                "source": SOURCES.get(name, ""),
                "created_at": "2024-01-01",
                "domain": DOMAINS.get(name, ""),
                "description": DESCRIPTIONS.get(name, ""),
                "data_interpretation_notes": NOTES.get(name, ""),
                "table_name": f" {name.upper()} " if i % 3 == 0 else None,
            }
        )
    return rows


def given_manifest(spark: SparkSession) -> DataFrame:
    columns = ["manifest_file", "entry_pos", *FIELDS]
    schema = "manifest_file string, entry_pos int, " + ", ".join(f"{f} string" for f in FIELDS)
    return small_table(spark, [tuple(r[c] for c in columns) for r in manifest_rows()], schema)


def given_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_of(spark, given_tables(spark, sf_dir))


# ---- derived input, one SQL expression read by both engines ------------------

_TABLE_LIST = ", ".join(f"'{t}'" for t in TABLES)
QUESTION_CASE = """CASE p_partkey % 8
  WHEN 0 THEN 'How many parts of ' || p_brand || ' have size ' || p_size || '?'
  WHEN 1 THEN 'Show all columns for the part name ' || p_name
  WHEN 2 THEN 'Which ' || p_type || ' items have a retail price and a total price?'
  WHEN 3 THEN 'Average of all columns by type ' || p_type || ' and brand'
  WHEN 4 THEN 'Show the country column of ' || p_name
  WHEN 5 THEN 'Find the order date, ship date and nation key of customer ' || p_partkey
  WHEN 6 THEN 'event type, user id and text source of ' || p_name || ' in documents'
  ELSE 'What is it? ' || p_name || ' label or quality, lang and url' END"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per part, each about one of the given tables."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("question_id"),
        F.expr(f"element_at(array({_TABLE_LIST}), cast(p_partkey % {len(TABLES)} as int) + 1)").alias("table_name"),
        F.expr(QUESTION_CASE).alias("question"),
    )


# ---- pieces of the comparison SQL -------------------------------------------


def quoted(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


STOPWORD_LIST = ", ".join(quoted(w) for w in fv.STOPWORDS)
QUESTIONS_SQL = f"""questions AS (
  SELECT p_partkey AS question_id, ([{_TABLE_LIST}])[p_partkey % {len(TABLES)} + 1] AS table_name,
         {QUESTION_CASE} AS question FROM part)"""

CATALOG_SQL = (
    "catalog(table_name, ordinal, column_name, data_type) AS (VALUES "
    + ", ".join(
        f"('{t}', {i}, '{c}', '{d}')" for t in TABLES for i, (c, d) in enumerate(COLUMNS[t], start=1)
    )
    + ")"
)


def tokens_sql(name: str, source: str, keys: str, text: str) -> str:
    """A CTE of distinct tokens per row: ``keys`` and ``token``."""
    return f"""{name} AS (
  SELECT DISTINCT {keys}, token FROM (
    SELECT {keys}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS token FROM {source})
  WHERE length(token) > 1 AND token NOT IN ({STOPWORD_LIST}))"""


def weights_sql(name: str, tokens: str, key: str) -> str:
    """A CTE of hashed unit vectors in long form, from a CTE of tokens."""
    return f"""{name}_n AS (
  SELECT {key}, CAST(('0x' || substr(md5(token), 1, 4)) AS BIGINT) % 64 AS bucket, count(*) AS n
  FROM {tokens} GROUP BY 1, 2),
{name} AS (
  SELECT {key}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS weight FROM {name}_n)"""
