"""The index of columns against scoring every column by hand; what a search reads."""

import math
import re

import pytest
from pyspark.sql import functions as F

from tabquest.operators import column_search as cs
from tabquest.session import work_dir

CATALOG = [
    ("fruit", 1, "fruit_id", "int"), ("fruit", 2, "colour", "string"), ("fruit", 3, "name", "string"),
    ("paint", 1, "colour_name", "string"), ("paint", 2, "maker", "string"),
]
FRUIT = [(1, "red", "apple"), (2, "Red-Green", "apple"), (3, None, "lime"), (4, "", "red currant")]
PAINT = [("green", "Apple"), ("red", None)]
DESCRIBED = [("fruit", "Fruit by colour"), ("paint", "Paint. Colour, maker")]
VALUES = {"fruit": ["colour", "name"], "paint": ["colour_name", "maker"]}
ASKED = [(1, "Which apple is red or green?"), (2, "colour and maker of paint"), (3, "nothing known"), (4, None), (5, ""), (6, "RED red red")]


def words(text):
    return {w for w in re.findall("[a-z0-9]+", (text or "").lower()) if len(w) > 1}


def by_hand(question):
    """Every column and dataset scored against the question."""
    rows = {"fruit": [dict(zip(("fruit_id", "colour", "name"), r)) for r in FRUIT], "paint": [dict(zip(("colour_name", "maker"), r)) for r in PAINT]}
    shares = {}
    for t, i, c, _ in CATALOG:
        own = {w: 2.0 for w in words(c.replace("_", " "))}
        cells = [r[c] for r in rows[t] if c in VALUES[t] and r[c] is not None]
        for w in {w for v in cells for w in words(v)}:
            own[w] = own.get(w, 0) + 0.5 + 0.5 * sum(w in words(v) for v in cells) / len(cells)
        shares["column", t, i, c] = own
    for t, d in DESCRIBED:
        shares["dataset", t, 0, ""] = {w: 1.0 for w in words(d)}
    hits = []
    for item, own in shares.items():
        kind = [s for i, s in shares.items() if i[0] == item[0]]
        n = {w: sum(w in s for s in kind) for w in own}
        score = sum(own[w] * math.log(1 + (len(kind) - n[w] + 0.5) / (n[w] + 0.5)) for w in words(question) if w in own)
        if score:
            hits.append((-round(score, 6), *item[1:3], item))
    ranks = {}
    for kind in ("column", "dataset"):
        for place, (_, _, _, item) in enumerate(sorted(h for h in hits if h[3][0] == kind), start=1):
            ranks[item] = place
    fused = []
    for (kind, t, i, c), place in ranks.items():
        if kind == "column":
            other = ranks.get(("dataset", t, 0, ""))
            fused.append((-round(1 / (60 + place) + (1 / (60 + other) if other else 0), 9), t, i, c, place, other))
    return [(t, c, place, other, -s, n) for n, (s, t, _, c, place, other) in enumerate(sorted(fused), start=1)]


@pytest.fixture(scope="module")
def index(spark):
    data = {
        "fruit": spark.createDataFrame(FRUIT, "fruit_id int, colour string, name string"),
        "paint": spark.createDataFrame(PAINT, "colour_name string, maker string"),
    }
    catalog = spark.createDataFrame(CATALOG, "table_name string, ordinal int, column_name string, data_type string")
    rows = cs.postings(catalog, cs.value_terms(data, VALUES), spark.createDataFrame(DESCRIBED, "table_name string, description string"))
    path = work_dir(spark, "index")
    cs.write_index(rows, path, parts=16)
    return path


def test_search_equals_scoring_every_column(spark, index):
    asked = spark.createDataFrame(ASKED, "question_id int, question string")
    found = {}
    for r in cs.search(asked, index, parts=16).orderBy("question_id", "rank").collect():
        found.setdefault(r["question_id"], []).append(tuple(r)[1:])
    for question_id, question in ASKED:
        assert found.get(question_id, []) == by_hand(question)
    assert set(found) == {1, 2, 6}
    best = cs.search(asked, index, parts=16, k=1).collect()
    assert sorted((r["question_id"], *tuple(r)[1:]) for r in best) == [(q, *by_hand(t)[0]) for q, t in ASKED if by_hand(t)]


def test_only_folders_of_the_asked_terms_are_read(spark, index):
    terms = spark.createDataFrame([("maker",), ("lime",)], "term string").withColumn("part", cs.term_part(F.col("term"), 16))
    wanted = {r["part"] for r in terms.collect()}
    read = cs.read_postings(spark, index, terms)
    files = {r[0] for r in read.select(F.input_file_name()).distinct().collect()}
    assert {int(re.search(r"part=(\d+)", f)[1]) for f in files} == wanted
    assert spark.read.parquet(index).select("part").distinct().count() > len(wanted)


def test_no_questions_and_no_hits(spark, index):
    none = spark.createDataFrame([], "question_id int, question string")
    assert cs.search(none, index, parts=16).count() == 0
    assert cs.search(spark.createDataFrame([(1, "zzz")], none.schema), index, parts=16).count() == 0
