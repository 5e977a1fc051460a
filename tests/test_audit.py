import pytest
from pyspark.sql import functions as F

from tabquest import fixed_values as fv
from tabquest.functions import sqltext
from tabquest.operators.audit import audit, check_sql, guarded_sql, sanity_problem


def judge(spark, sql, expected=None):
    row = audit(spark.createDataFrame([(sql, expected)], "sql string, expected_table string")).first()
    return row["violations"], row["detected_tables"], row["normalized_sql"]


ONE = fv.MSG_ONE_TABLE
SELECT = fv.MSG_NOT_SELECT


@pytest.mark.parametrize(
    "sql, expected, violations",
    [
        ("SELECT a FROM t", None, []),
        ("  select a from t ; ;", "T", [fv.MSG_MULTIPLE]),
        ("select a from t;", "T", []),
        ("select a from t;;", "T", [fv.MSG_MULTIPLE]),
        ('SELECT "a;b" FROM "My Table"', "my table", []),
        ("", None, [fv.MSG_EMPTY, SELECT, ONE]),
        (None, None, [fv.MSG_EMPTY, SELECT, ONE]),
        ("SELECT 1 -- x", None, [fv.MSG_COMMENTS, ONE]),
        ("SELECT '--' FROM t", None, []),
        ("SELECT 'it''s; -- fine' FROM t", None, []),
        ("SELECT a FROM t; SELECT b FROM t", None, [fv.MSG_MULTIPLE, ONE]),
        ("SELECT a FROM t; 'tail'", None, [fv.MSG_MULTIPLE]),
        ("SELECT a FROM t WHERE x = 'open; y", None, []),
        ("WITH x AS (SELECT 1) SELECT * FROM x", None, [SELECT]),
        ("(SELECT a FROM t)", None, [SELECT]),
        ("SELECT replace(a, 'x', 'y') FROM t", None, [fv.MSG_KEYWORD + "replace"]),
        ('SELECT "update", "drop" FROM t', None, [fv.MSG_KEYWORD + "update", fv.MSG_KEYWORD + "drop"]),
        ("SELECT updated FROM t", None, []),
        ("SELECT a FROM t JOIN u ON 1 = 1", None, [fv.MSG_JOIN]),
        ("SELECT a FROM t, u", None, [fv.MSG_COMMA_FROM]),
        ("SELECT a FROM t ORDER BY a, b", None, []),
        ("SELECT a FROM t WINDOW w AS (PARTITION BY a, b)", None, [fv.MSG_COMMA_FROM]),
        ("SELECT EXTRACT(year FROM d) FROM t", None, [ONE]),
        ("SELECT a FROM (SELECT b FROM t)", None, []),
        ("SELECT a FROM u", "T", ["Query references unexpected table 'u', expected 'T'."]),
        ("SELECT a FROM u", "", []),
        ("DELETE FROM t", None, [SELECT, fv.MSG_KEYWORD + "delete"]),
        ("SELECT a\nFROM\n\tt\nGROUP  BY a, b", "t", []),
    ],
)
def test_rules(spark, sql, expected, violations):
    assert judge(spark, sql, expected)[0] == violations


def test_detected_tables_and_normalized_text(spark):
    assert judge(spark, ' SELECT a FROM "My T" ; ')[1:] == (["my t"], 'SELECT a FROM "My T"')
    assert judge(spark, "SELECT x FROM (SELECT y FROM b1) ")[1] == ["b1"]


def test_long_literals_do_not_overflow(spark):
    sql = "SELECT '" + "x''" * 20000 + "' FROM t"
    assert judge(spark, sql)[0] == []


def test_strip_quoted_content(spark):
    df = spark.createDataFrame([("a 'b''c' \"d\" '' 'e",)], "s string")
    assert df.select(sqltext.strip_quoted_content(F.col("s"))).first()[0] == "a '' \"d\" '' 'e"


def test_sanity(spark):
    df = spark.createDataFrame([(" SELECT 1 FROM Part",), ("x",), ("select 2",)], "s string")
    assert [r[0] for r in df.select(sanity_problem(F.col("s"), F.lit("PART"))).collect()] == [
        None, fv.MSG_SANITY_SELECT, fv.MSG_SANITY_TABLE,
    ]


def test_guarded_sql(spark):
    spark.range(50).selectExpr("id", "id % 2 AS `odd one`").createOrReplaceTempView("guard_numbers")
    rows = guarded_sql(spark, 'SELECT "id" FROM "guard_numbers" WHERE "odd one" = 1 ORDER BY "id";', "guard_numbers", 3).collect()
    assert [r["id"] for r in rows] == [1, 3, 5]
    assert len(guarded_sql(spark, "SELECT id FROM guard_numbers").collect()) == 20
    with pytest.raises(ValueError, match="Only SELECT"):
        guarded_sql(spark, "DROP TABLE guard_numbers")
    result, df = check_sql(spark, "SELECT nope FROM guard_numbers")
    assert df is None and not result["is_valid"] and not result["syntax_ok"] and "Spark rejected" in result["violations"][0]
    assert spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers") == "false"


def test_audit_needs_no_shuffle(spark):
    df = spark.range(10).selectExpr("cast(id as string) AS sql", "cast(null as string) AS expected_table")
    assert "Exchange" not in audit(df)._jdf.queryExecution().executedPlan().toString()


def test_quoted_names_need_no_ansi_session(spark):
    spark.range(6).selectExpr("id", "id % 2 AS g").createOrReplaceTempView("halves")
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        found = guarded_sql(spark, 'SELECT "id" FROM halves WHERE "g" = 1').collect()
        assert spark.conf.get("spark.sql.ansi.enabled") == "false"
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    assert sorted(r["id"] for r in found) == [1, 3, 5]
