from pyspark.sql import functions as F

from tabquest.operators import single_table as ops


def test_distribution(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "v string")
    assert {tuple(r) for r in ops.distribution(df, "v").collect()} == {("a", 2, 50.0), ("b", 1, 25.0), (None, 1, 25.0)}


def test_averages_over_hundreds_of_columns(spark):
    wide = spark.range(10).select(*[(F.col("id") * i).alias(f"col {i}") for i in range(400)], F.lit("x").alias("text"))
    found = {r["column_name"]: r["average"] for r in ops.column_averages(wide).collect()}
    assert len(found) == 400 and found["col 399"] == 4.5 * 399


def test_pairs_lists_and_flags(spark):
    df = spark.createDataFrame([("x", "y", "a, b ,c", 1, 0), ("y", "x", "b", 1, 1), ("z", "q", None, 0, 1)], "p string, q string, l string, f int, g int")
    assert df.filter(ops.either_column("p", "q", "x")).count() == 2
    assert {tuple(r) for r in df.select(*ops.unordered_pair("p", "q")).distinct().collect()} == {("x", "y"), ("q", "z")}
    assert df.filter(ops.has_member(F.col("l"), "b")).count() == 2
    assert df.filter(ops.flags_set("f", "g")).count() == 1


def test_result_records_and_truncation(spark):
    df = spark.range(25).select("id", F.expr("date_add(date'2024-01-01', int(id))").alias("d"), F.lit(None).cast("int").alias("n"))
    rows = [r[0] for r in ops.result_records(df.orderBy("id"), 2).collect()]
    assert rows == ['{"id":0,"d":"2024-01-01","n":null}', '{"id":1,"d":"2024-01-02","n":null}']
    assert ops.is_truncated(df) and not ops.is_truncated(df, 25)


def test_summary_tells_what_was_cut(spark):
    df = spark.range(25).orderBy("id")
    cut, whole = ops.result_summary(df, 20).first(), ops.result_summary(df, 25).first()
    assert (cut["row_count_returned"], cut["limit_applied"], cut["is_truncated"], len(cut["rows"])) == (20, 20, True, 20)
    assert cut["rows"][:2] == ['{"id":0}', '{"id":1}'] and cut["columns"] == ["id"]
    assert (whole["row_count_returned"], whole["is_truncated"]) == (25, False)
    none = ops.result_summary(df.filter("id < 0")).first()
    assert (none["row_count_returned"], none["rows"], none["is_truncated"]) == (0, [], False)
