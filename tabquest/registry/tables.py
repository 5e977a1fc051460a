"""Single-table queries, ingest, profile and name resolution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabquest import fixed_values as fv
from tabquest.functions.names import file_stem, normalize_name, table_name_of
from tabquest.operators import lookups
from tabquest.operators import single_table as ops
from tabquest.plans import profile
from tabquest.registry.common import (
    CATALOG_SQL,
    COLUMNS,
    GIVEN,
    TABLES,
    file_path,
    found_tables,
    given_manifest,
    given_tables,
    manifest_rows,
    quoted,
    registrar,
    table,
)
from tabquest.session import configure, materialise, work_dir
from tabquest.sources.manifest import filter_manifest, manifest_from_rows, read_manifest, split_valid
from tabquest.sources.metadata import read_written_metadata, write_metadata
from tabquest.sources.tables import import_csv, import_manifest, session_catalog

QUERIES, ORACLES = {}, {}


register = registrar(QUERIES, ORACLES)


@register(
    "group_count_share",
    """SELECT o_orderstatus, count(*) AS row_count,
              round(100.0 * count(*) / sum(count(*)) OVER (), 3) AS percentage
       FROM orders GROUP BY o_orderstatus""",
)
def group_count_share(spark, sf_dir):
    return ops.distribution(table(spark, sf_dir, "orders"), "o_orderstatus")


@register("focused_filter", "SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0")
def focused_filter(spark, sf_dir):
    flags = table(spark, sf_dir, "labels")
    return flags.filter(ops.flags_set("quality") & (F.col("toxic") == 0)).select("doc_id")


@register(
    "typed_predicates",
    """SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
       WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-07-01'
         AND l_discount BETWEEN 0.05 AND 0.07 AND NOT (l_returnflag = 'R')""",
)
def typed_predicates(spark, sf_dir):
    shipped = F.col("l_shipdate")
    return (
        table(spark, sf_dir, "lineitem")
        .filter((shipped >= F.lit("1997-01-01").cast("timestamp_ntz")) & (shipped < F.lit("1997-07-01").cast("timestamp_ntz")))
        .filter(F.col("l_discount").between(0.05, 0.07) & ~(F.col("l_returnflag") == "R"))
        .select("l_orderkey", "l_linenumber", "l_extendedprice")
    )


@register("full_record", "SELECT * FROM part WHERE p_name = 'red widget' AND p_type = 'ECONOMY'")
def full_record(spark, sf_dir):
    return table(spark, sf_dir, "part").filter("p_name = 'red widget' AND p_type = 'ECONOMY'")


@register(
    "having_filter",
    """SELECT l_orderkey, count(*) AS line_count, CAST(sum(l_quantity) AS DOUBLE) AS total_quantity
       FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 150""",
)
def having_filter(spark, sf_dir):
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.count("*").alias("line_count"), F.sum("l_quantity").alias("total_quantity"))
        .filter(F.col("total_quantity") > 150)
    )


@register(
    "top_n_sorted",
    "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 10",
)
def top_n_sorted(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return ops.top_rows(people, [F.col("c_acctbal").desc_nulls_last(), F.col("c_custkey")], 10)


@register(
    "basic_aggregates",
    """SELECT l_returnflag, l_linestatus, count(*) AS row_count, round(sum(l_extendedprice), 2) AS total_price,
              round(avg(l_discount), 6) AS average_discount, min(l_quantity) AS min_quantity,
              max(l_quantity) AS max_quantity
       FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def basic_aggregates(spark, sf_dir):
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.count("*").alias("row_count"),
            F.round(F.sum("l_extendedprice"), 2).alias("total_price"),
            F.round(F.avg("l_discount"), 6).alias("average_discount"),
            F.min("l_quantity").alias("min_quantity"),
            F.max("l_quantity").alias("max_quantity"),
        )
    )


_NUMERIC = [c for c, d in COLUMNS["lineitem"] if d in ("bigint", "int", "double")]


@register(
    "broad_aggregate",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(avg({c}), 4) AS average FROM lineitem" for c in _NUMERIC
    ),
)
def broad_aggregate(spark, sf_dir):
    return ops.column_averages(table(spark, sf_dir, "lineitem"))


@register(
    "pair_lookup",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey = 17 OR l_suppkey = 17",
)
def pair_lookup(spark, sf_dir):
    return (
        table(spark, sf_dir, "lineitem")
        .filter(ops.either_column("l_partkey", "l_suppkey", 17))
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    )


@register(
    "pair_counts",
    """SELECT least(l_partkey, l_suppkey) AS pair_low, greatest(l_partkey, l_suppkey) AS pair_high,
              count(*) AS row_count FROM lineitem GROUP BY 1, 2""",
)
def pair_counts(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select(*ops.unordered_pair("l_partkey", "l_suppkey"))
    return pairs.groupBy("pair_low", "pair_high").agg(F.count("*").alias("row_count"))


@register("prefix_match", "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE 'Customer#0000001%'")
def prefix_match(spark, sf_dir):
    return table(spark, sf_dir, "customer").filter(F.col("c_name").like("Customer#0000001%")).select("c_custkey", "c_name")


@register(
    "list_member_counts",
    """SELECT member, count(*) AS row_count,
              count(*) FILTER (list_contains(members, 'red')) AS next_to_red
       FROM (SELECT members, unnest(members) AS member FROM (
         SELECT [trim(m) FOR m IN string_split(replace(p_name, ' ', ', '), ',')] AS members FROM part))
       GROUP BY member""",
)
def list_member_counts(spark, sf_dir):
    listed = table(spark, sf_dir, "part").select(F.expr("replace(p_name, ' ', ', ')").alias("words"))
    return (
        listed.select(
            F.explode(ops.list_members(F.col("words"))).alias("member"),
            ops.has_member(F.col("words"), "red").alias("has_red"),
        )
        .groupBy("member")
        .agg(F.count("*").alias("row_count"), F.count_if("has_red").alias("next_to_red"))
    )


_EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


@register(
    "flag_prevalence",
    "WITH flags AS (SELECT user_id, "
    + ", ".join(f"max(CASE WHEN event_type = '{t}' AND value > 100 THEN 1 ELSE 0 END) AS {t}" for t in _EVENT_TYPES)
    + " FROM events GROUP BY user_id) "
    + " UNION ALL ".join(
        f"SELECT '{t}' AS flag, CAST(sum({t}) AS BIGINT) AS with_flag, round(avg({t}), 6) AS prevalence FROM flags"
        for t in _EVENT_TYPES
    ),
)
def flag_prevalence(spark, sf_dir):
    large = F.when(F.col("value") > 100, F.col("event_type"))
    seen = table(spark, sf_dir, "events").select("user_id", large.alias("large_event"))
    return ops.flag_prevalence(seen, "user_id", "large_event", _EVENT_TYPES)


@register(
    "null_filter",
    """SELECT d.lang, count(*) AS documents, count(*) FILTER (l.quality IS NULL) AS unlabelled,
              count(*) FILTER (l.quality IS NOT NULL AND l.quality = 0) AS rejected
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang""",
)
def null_filter(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return (
        documents.join(table(spark, sf_dir, "labels"), "doc_id", "left")
        .groupBy("lang")
        .agg(
            F.count("*").alias("documents"),
            F.count_if(F.col("quality").isNull()).alias("unlabelled"),
            F.count_if(F.col("quality").isNotNull() & (F.col("quality") == 0)).alias("rejected"),
        )
    )


_NORMAL_SQL = """CASE WHEN regexp_matches({0}, '^[0-9]') THEN 'dataset_' || {0} ELSE {0} END"""
_CLEAN_SQL = """trim(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '_')"""


def normal_sql(value: str) -> str:
    return _NORMAL_SQL.format(_CLEAN_SQL.format(value))


@register(
    "normalize_names",
    f"""SELECT 'url' AS kind, page_id AS id, {normal_sql('url')} AS name FROM pages
        UNION ALL SELECT 'size', p_partkey, {normal_sql("p_size || ' ' || p_name")} FROM part""",
)
def normalize_names(spark, sf_dir):
    urls = table(spark, sf_dir, "pages").select(
        F.lit("url").alias("kind"), F.col("page_id").alias("id"), normalize_name(F.col("url")).alias("name")
    )
    sizes = table(spark, sf_dir, "part").select(
        F.lit("size").alias("kind"),
        F.col("p_partkey").alias("id"),
        normalize_name(F.concat_ws(" ", F.col("p_size").cast("string"), "p_name")).alias("name"),
    )
    return urls.union(sizes)


_SEGMENT_SQL = "regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1)"


@register(
    "record_ids",
    f"""SELECT page_id, CASE WHEN regexp_matches(segment, '.[.][^.]+$')
               THEN regexp_replace(segment, '[.][^.]+$', '') ELSE segment END AS record_id
        FROM (SELECT page_id, {_SEGMENT_SQL} AS segment FROM pages)""",
)
def record_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", file_stem(F.col("url")).alias("record_id"))


# ---- profiles ---------------------------------------------------------------

def sizes_sql() -> str:
    return "sizes AS (" + " UNION ALL ".join(
        f"SELECT '{file_path(t)}' AS file_path, (SELECT count(*) FROM {t}) AS num_rows, "
        f"CAST({len(COLUMNS[t])} AS BIGINT) AS num_columns, "
        f"'{', '.join(c for c, _ in COLUMNS[t][:fv.PREVIEW_COLUMNS])}' AS preview"
        for t in TABLES
    ) + ")"


def manifest_sql() -> str:
    rows = ", ".join(
        "("
        + ", ".join(
            [str(r["entry_pos"])]
            + [
                quoted(r[c])
                for c in ("file_path", "dataset_name", "source", "domain", "description", "data_interpretation_notes")
            ]
            + [quoted(t)]
        )
        + ")"
        for t, r in zip(TABLES, manifest_rows())
    )
    return f"manifest(entry_pos, file_path, given_name, source, domain, about, notes, table_name) AS (VALUES {rows})"


PROFILE_SQL = f"""{sizes_sql()}, {manifest_sql()},
named AS (SELECT m.*, s.num_rows, s.num_columns, s.preview,
            CASE WHEN given_name = '' THEN m.table_name ELSE given_name END AS dataset_name
          FROM manifest m JOIN sizes s USING (file_path)),
profile AS (SELECT file_path, table_name, dataset_name, source, domain, notes, num_rows, num_columns,
    CASE WHEN about = '' THEN dataset_name || ' is a healthcare dataset.' ELSE about END
      || ' It contains ' || format('{{:,}}', num_rows) || ' rows and ' || num_columns
      || ' columns in CSV format.' AS description,
    'Dataset: ' || dataset_name || '. Source: ' || CASE source WHEN '' THEN 'local CSV file' ELSE source END
      || '. Domain: ' || CASE domain WHEN '' THEN 'healthcare' ELSE domain END
      || '. Rows: ' || num_rows || '. Columns: ' || num_columns || '.'
      || CASE about WHEN '' THEN '' ELSE ' Description: ' || about END
      || CASE notes WHEN '' THEN '' ELSE ' {fv.NOTES_LABEL}' || notes END
      || ' Column preview: ' || preview || '. {fv.RETRIEVAL_SENTENCE}' AS embedding_text
  FROM named)"""


def profiles(spark, sf_dir) -> DataFrame:
    """Metadata of the given tables without their samples."""
    datasets = {file_path(t): df for t, df in given_tables(spark, sf_dir).items()}
    return profile.describe(given_manifest(spark), profile.table_sizes(datasets))


@register(
    "dataset_profile",
    f"""WITH {PROFILE_SQL} SELECT file_path, dataset_name, source, domain, num_rows, num_columns,
        description, embedding_text FROM profile""",
)
def dataset_profile(spark, sf_dir):
    return profiles(spark, sf_dir).select(
        "file_path", "dataset_name", "source", "domain", "num_rows", "num_columns", "description", "embedding_text"
    )


# Tables with the columns that order them; vectors are left out, as engines write them differently.
_SAMPLED = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey",
    "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey, l_linenumber, l_partkey, l_suppkey",
    "events": "event_id", "documents": "doc_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id",
    "conversations": "conv_id, turn",
}


def _sample_sql(name: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, position, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM s_{name}"
        for c, _ in COLUMNS[name]
    )


@register(
    "sample_rows",
    "WITH "
    + ", ".join(
        f"s_{t} AS (SELECT *, row_number() OVER (ORDER BY {k}) - 1 AS position FROM (SELECT * FROM {t} ORDER BY {k} LIMIT 3))"
        for t, k in _SAMPLED.items()
    )
    + " "
    + " UNION ALL ".join(_sample_sql(t) for t in _SAMPLED),
)
def sample_rows(spark, sf_dir):
    cells = [
        profile.sample_cells(table(spark, sf_dir, t), k.split(", ")).select(F.lit(t).alias("table_name"), "*")
        for t, k in _SAMPLED.items()
    ]
    return reduce(DataFrame.union, cells)


@register(
    "catalog_columns",
    f"""WITH {CATALOG_SQL}, counts AS ({' UNION ALL '.join(f"SELECT '{t}' AS table_name, count(*) AS num_rows FROM {t}" for t in TABLES)})
        SELECT table_name, ordinal, column_name, data_type, num_rows FROM catalog JOIN counts USING (table_name)""",
)
def catalog_columns(spark, sf_dir):
    """Columns as the files declare them, found through the session's views, with row counts."""
    for t, df in found_tables(spark, sf_dir).items():
        df.createOrReplaceTempView(f"given_{t}")
    views = {f"given_{t}" for t in TABLES}
    found = session_catalog(spark).filter(F.col("table_name").isin(*views))
    sizes = [
        spark.table(v).agg(F.count("*").alias("num_rows")).select(F.lit(v).alias("table_name"), "num_rows")
        for v in sorted(views)
    ]
    return found.join(reduce(DataFrame.union, sizes), "table_name").withColumn(
        "table_name", F.regexp_replace("table_name", "^given_", "")
    )


# ---- ingest -----------------------------------------------------------------


@register(
    "csv_import_roundtrip",
    """SELECT 'part' AS table_name, count(*) AS num_rows, CAST(sum(p_partkey) AS BIGINT) AS key_sum,
              count(DISTINCT p_name) AS names, round(sum(p_retailprice), 2) AS amount FROM part
       UNION ALL SELECT 'orders', count(*), CAST(sum(o_orderkey) AS BIGINT), count(DISTINCT o_orderpriority),
              round(sum(o_totalprice), 2) FROM orders""",
)
def csv_import_roundtrip(spark, sf_dir):
    """Write two tables as CSV, import them by manifest, keep them on a second run, read them back."""
    configure(spark)
    folder = work_dir(spark, "import")
    tag = folder.rsplit("-", 1)[-1]
    names = {t: f"{t}_{tag}" for t in ("part", "orders")}
    entries = []
    for i, (source, name) in enumerate(names.items()):
        table(spark, sf_dir, source).write.option("header", True).csv(f"{folder}/csv/{source}")
        entries.append((i, f"{folder}/csv/{source}", name))
    manifest = manifest_from_rows(
        spark.createDataFrame(entries, "position int, file_path string, dataset_name string"), "position"
    )
    import_manifest(spark, manifest, location=f"{folder}/tables", multiline=False)
    import_csv(spark, f"{folder}/csv/part", names["part"])
    part, orders = spark.table(names["part"]), spark.table(names["orders"])
    result = materialise(_imported(part, orders), "imported")
    for name in names.values():
        spark.sql(f"DROP TABLE {name}")
    return result


def _imported(part, orders) -> DataFrame:
    return part.agg(
        F.lit("part").alias("table_name"),
        F.count("*").alias("num_rows"),
        F.sum("p_partkey").alias("key_sum"),
        F.count_distinct("p_name").alias("names"),
        F.round(F.sum("p_retailprice"), 2).alias("amount"),
    ).union(
        orders.agg(
            F.lit("orders"),
            F.count("*"),
            F.sum("o_orderkey"),
            F.count_distinct("o_orderpriority"),
            F.round(F.sum("o_totalprice"), 2),
        )
    )


@register(
    "csv_text_roundtrip",
    """SELECT doc_id, md5(text) AS text_md5, lang, source, n_chars FROM documents""",
)
def csv_text_roundtrip(spark, sf_dir):
    """Texts with line breaks and quotes through CSV: given columns, imported by manifest, read back."""
    configure(spark)
    folder = work_dir(spark, "texts")
    name = "texts_" + folder.rsplit("-", 1)[-1]
    writer = table(spark, sf_dir, "documents").write.option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{folder}/csv")
    entries = spark.createDataFrame([(0, f"{folder}/csv", name)], "position int, file_path string, dataset_name string")
    import_manifest(spark, manifest_from_rows(entries, "position"), schemas={name: GIVEN["documents"]})
    result = materialise(spark.table(name).withColumn("text_md5", F.md5("text")).drop("text"), "texts")
    spark.sql(f"DROP TABLE {name}")
    return result


@register(
    "metadata_roundtrip",
    f"""WITH {PROFILE_SQL} SELECT file_path, dataset_name, num_rows, num_columns, embedding_text,
          least(num_rows, 3) AS samples FROM profile""",
)
def metadata_roundtrip(spark, sf_dir):
    """Metadata of all given tables with their samples, written as JSON and read back."""
    folder = work_dir(configure(spark), "metadata")
    datasets = {file_path(t): df for t, df in given_tables(spark, sf_dir).items()}
    write_metadata(profile.build_metadata(given_manifest(spark), datasets, 3), folder)
    return read_written_metadata(spark, folder).select(
        "file_path", "dataset_name", "num_rows", "num_columns", "embedding_text",
        F.size("sample_rows").cast("long").alias("samples"),
    )


_ENTRY_NAME = "CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN '  ' || p_name || ' ' WHEN 2 THEN '' ELSE p_name END"
_ENTRY_FILE = "CASE p_partkey % 7 WHEN 0 THEN '' ELSE 'data/' || p_brand || '/' || p_type || '.' || p_partkey || '.csv' END"


def part_manifest(spark, sf_dir) -> DataFrame:
    """A manifest with one entry per part: repeated names, mixed case, blanks, missing files."""
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("position"),
        F.expr(_ENTRY_NAME).alias("dataset_name"),
        F.expr(_ENTRY_FILE).alias("file_path"),
    )
    return manifest_from_rows(rows, "position")


@register(
    "manifest_filter",
    f"""SELECT entry_pos, dataset_name, file_path, file_path = '' AS is_rejected
        FROM (SELECT p_partkey AS entry_pos, {_ENTRY_NAME} AS dataset_name, {_ENTRY_FILE} AS file_path FROM part)
        WHERE lower(trim(dataset_name)) IN ('red widget', 'small ring')""",
)
def manifest_filter(spark, sf_dir):
    """The manifest goes through files, each a JSON array of at most 1000 entries, and is read back."""
    folder = work_dir(configure(spark), "manifest")
    entry = F.struct("entry_pos", "dataset_name", "file_path", F.col("entry_pos").cast("string").alias("created_at"))
    (
        part_manifest(spark, sf_dir)
        .groupBy(F.floor(F.col("entry_pos") / 1000).alias("chunk"))
        .agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("value"))
        .write.partitionBy("chunk")
        .text(folder)
    )
    wanted = filter_manifest(read_manifest(spark, folder), ["Red Widget ", "small ring"])
    valid, rejected = split_valid(wanted, ["file_path"])
    shown = [F.col("created_at").cast("bigint").alias("entry_pos"), "dataset_name", "file_path"]
    return valid.select(*shown, F.lit(False).alias("is_rejected")).union(
        rejected.select(*shown, F.lit(True).alias("is_rejected"))
    )


_WANTED_NAME = "CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN ' ' || p_name ELSE p_name || ' unknown' END"
_WANTED_TABLE = "CASE WHEN p_size % 9 = 0 THEN 'Given ' || p_brand ELSE NULL END"


@register(
    "table_resolution",
    f"""WITH entries AS (
          SELECT lower(trim(dataset_name)) AS k, p_partkey, {normal_sql('dataset_name')} AS t FROM (
            SELECT p_partkey, {_ENTRY_NAME} AS dataset_name FROM part) WHERE trim(dataset_name) <> ''),
        firsts AS (SELECT k, t FROM (SELECT k, t, row_number() OVER (PARTITION BY k ORDER BY p_partkey) AS n FROM entries) WHERE n = 1)
        SELECT p_partkey AS request_id, coalesce(asked_table, t) AS resolved_table FROM (
          SELECT p_partkey, {_WANTED_NAME} AS asked, {_WANTED_TABLE} AS asked_table FROM part) r
        LEFT JOIN firsts ON firsts.k = lower(trim(r.asked))""",
)
def table_resolution(spark, sf_dir):
    requests = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("request_id"),
        F.expr(_WANTED_NAME).alias("dataset_name"),
        F.expr(_WANTED_TABLE).alias("table_name"),
    )
    return lookups.resolve_table_names(requests, part_manifest(spark, sf_dir)).select("request_id", "resolved_table")


@register(
    "expected_table",
    f"""SELECT p_partkey AS request_id, CASE WHEN p_partkey % 5 = 0 THEN 'payload_' || p_size
               WHEN p_partkey % 5 = 1 THEN 'written_' || p_size
               WHEN p_size % 9 = 0 THEN 'Given ' || p_brand
               WHEN p_partkey % 3 = 2 THEN NULL
               ELSE {normal_sql('p_name')} END AS expected_table FROM part""",
)
def expected_table(spark, sf_dir):
    requests = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("request_id"),
        F.expr("CASE WHEN p_partkey % 5 = 0 THEN 'payload_' || p_size END").alias("payload_table"),
        F.expr("CASE WHEN p_partkey % 5 <= 1 THEN 'written_' || p_size ELSE '' END").alias("generated_table"),
        F.expr(_WANTED_TABLE).alias("table_name"),
        F.expr(_WANTED_NAME).alias("dataset_name"),
    )
    return lookups.expected_tables(requests, part_manifest(spark, sf_dir)).select("request_id", "expected_table")


@register(
    "manifest_tables",
    f"""SELECT p_partkey AS entry_pos,
          CASE WHEN trim(dataset_name) <> '' THEN {normal_sql('dataset_name')}
               ELSE {normal_sql("p_type || '.' || p_partkey")} END AS table_name
        FROM (SELECT *, {_ENTRY_NAME} AS dataset_name, {_ENTRY_FILE} AS file_path FROM part) WHERE file_path <> ''""",
)
def manifest_tables(spark, sf_dir):
    """Table name of every entry that has a file: by dataset name, else by file stem."""
    valid, _ = split_valid(part_manifest(spark, sf_dir), ["file_path"])
    name = table_name_of(F.col("table_name"), F.col("dataset_name"), F.col("file_path"))
    return valid.select("entry_pos", name.alias("table_name"))
