import pytest
from pyspark.sql import functions as F

from tabquest import fixed_values as fv
from tabquest.functions import names, text


def values(spark, rows, column, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


def test_strip_removes_every_kind_of_white_space(spark):
    assert values(spark, ["\t a b\n", " x ", "\x1cy\x1f", "   "], names.strip(F.col("v"))) == ["a b", "x", "y", ""]


def test_normalize_name(spark):
    given = ["Drug-Drug Interactions  Dataset", "__A__b__", "2024 sales", " Ünïcode name "]
    assert values(spark, given, names.normalize_name(F.col("v"))) == [
        "drug_drug_interactions_dataset", "a_b", "dataset_2024_sales", "n_code_name",
    ]


def test_normalize_name_without_letters_or_digits(spark):
    assert values(spark, ["--"], names.normalize_name(F.col("v"), strict=False)) == [None]
    with pytest.raises(Exception, match="Cannot derive a valid table name"):
        values(spark, ["--"], names.normalize_name(F.col("v")))


def test_file_stem_drops_the_last_extension_only(spark):
    given = ["data/a.b.csv", "plain", "x/.hidden", "dir/file.", "a/b.csv/"]
    assert values(spark, given, names.file_stem(F.col("v"))) == ["a.b", "plain", ".hidden", "file.", "b"]


def test_table_name_precedence(spark):
    rows = [(" My Table ", "Other", "d/f.csv"), (" ", "Other Name", "d/f.csv"), (None, None, "d/9 f.csv")]
    df = spark.createDataFrame(rows, "t string, d string, f string")
    found = [r[0] for r in df.select(names.table_name_of(F.col("t"), F.col("d"), F.col("f"))).collect()]
    assert found == ["my_table", "other_name", "dataset_9_f"]


def test_tokenize(spark):
    found = values(spark, ["Show THE fever-fever a b c3 x_y columns of 42"], text.tokenize(F.col("v")))[0]
    assert sorted(found) == ["42", "c3", "fever"]


@pytest.mark.parametrize(
    "question, mode",
    [
        ("Which diseases have fever and cough?", fv.MODE_FOCUSED),
        ("Show all symptoms of influenza", fv.MODE_BROAD),
        ("How many respondents received treatment?", fv.MODE_AGGREGATE),
        ("Show the country column", fv.MODE_AGGREGATE),
        ("moderate cases", fv.MODE_AGGREGATE),
        ("average of ALL SYMPTOMS", fv.MODE_BROAD_AGGREGATE),
        ("", fv.MODE_FOCUSED),
        (None, fv.MODE_FOCUSED),
    ],
)
def test_query_mode(spark, question, mode):
    assert values(spark, [question], text.query_mode(F.col("v"))) == [mode]


def test_description_and_embedding_text(spark):
    columns = [f"c{i}" for i in range(1, 17)]
    df = spark.createDataFrame(
        [("Survey", "", "", "", "", columns, 1234567, 16), ("Labels", "site", "health", "Short.", "0 means no", ["a", "b"], 3, 2)],
        "n string, s string, d string, about string, notes string, cols array<string>, r long, c long",
    )
    described = [r[0] for r in df.select(text.dataset_description(F.col("n"), F.col("about"), F.col("r"), F.col("c"))).collect()]
    assert described == [
        "Survey is a healthcare dataset. It contains 1,234,567 rows and 16 columns in CSV format.",
        "Short. It contains 3 rows and 2 columns in CSV format.",
    ]
    made = text.embedding_text(*[F.col(c) for c in ("n", "s", "d", "about", "notes", "cols", "r", "c")])
    first, second = [r[0] for r in df.select(made).collect()]
    assert first == (
        "Dataset: Survey. Source: local CSV file. Domain: healthcare. Rows: 1234567. Columns: 16. Column preview: "
        + ", ".join(columns[:15]) + ", .... " + fv.RETRIEVAL_SENTENCE
    )
    assert second == (
        "Dataset: Labels. Source: site. Domain: health. Rows: 3. Columns: 2. Description: Short. "
        "Data interpretation notes: 0 means no Column preview: a, b. " + fv.RETRIEVAL_SENTENCE
    )


def test_search_document_adds_unknown_notes_once(spark):
    df = spark.createDataFrame(
        [
            (" base ", "", ""),
            ("base", "", " from manifest "),
            ("base Data interpretation notes: known", "known", "other"),
            (None, "n", None),
        ],
        "t string, a string, b string",
    )
    found = [r[0] for r in df.select(text.search_document(F.col("t"), F.col("a"), F.col("b"))).collect()]
    assert found == [
        "base",
        "base Data interpretation notes: from manifest",
        "base Data interpretation notes: known",
        "Data interpretation notes: n",
    ]
