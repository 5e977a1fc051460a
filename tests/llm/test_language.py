"""Language identification: held-out accuracy, the backing off, odd input."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import rows_of

from tabquest.llm import language


def remainder(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4


@pytest.fixture(scope="module")
def model(given):
    return language.fit(given("documents"))


def test_held_out_accuracy(given, model):
    langs = {r["doc_id"]: r["lang"] for r in rows_of(given("documents").select("doc_id", "lang"))}
    found = rows_of(language.predict(given("documents"), model))
    assert len(found) == len(langs)
    assert all(r["held_out"] == (remainder(r["doc_id"]) == 2) and 0 <= r["score"] <= 1 for r in found)
    right = [r["lang_pred"] == langs[r["doc_id"]] for r in found if r["held_out"] and langs[r["doc_id"]]]
    assert sum(right) >= 0.95 * len(right)


def test_held_out_labels_and_lang_do_not_matter(spark, given):
    from pyspark.sql import functions as F

    docs = given("documents")
    wrong = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    model = language.fit(wrong)
    assert "xx" not in model.languages
    hidden = language.predict(docs.withColumn("lang", F.lit(None).cast("string")), model)
    assert sorted(map(str, rows_of(hidden))) == sorted(map(str, rows_of(language.predict(docs, model))))


def test_word_first_then_shorter_grams():
    rows = [(0, "a", "cat", 8), (0, "b", "dog", 8), (4, "a", " cat", 3), (3, "b", "dog", 5), (2, "a", "zz", 5), (1, "b", "q", 5)]
    model = language.Model(["a", "b"], rows)
    assert np.allclose(model.vector("cat"), model.tables[0]["cat"])
    assert np.allclose(model.vector("cats"), model.tables[4][" cat"])  # a known 4-gram
    assert np.allclose(model.vector("dogs"), model.tables[3]["dog"])  # no 4-gram, a 3-gram
    assert np.allclose(model.vector("pzzp"), model.tables[2]["zz"])
    assert np.allclose(model.vector("q"), model.tables[1]["q"])
    assert model.vector("漢") is None
    languages, scores = language.Predictor(model)(pa.array(["cat cat", "dog, Dogs", "", "12 3", "漢"], pa.string()))
    assert languages == ["a", "b", "und", "und", "a"]  # a letter, but nothing known: the first
    assert scores[2] == scores[3] == 0 and np.isclose(scores[4], 0.5)


def test_batches_equal_single_texts(given, model, monkeypatch):
    monkeypatch.setattr(language, "_KEPT", 50)
    texts = [r["text"] for r in rows_of(given("documents").limit(30))]
    together = language.Predictor(model)(pa.array(texts, pa.string()))
    alone = [language.Predictor(model)(pa.array([t], pa.string())) for t in texts]
    assert together[0] == [a[0][0] for a in alone]
    assert np.allclose(together[1], [a[1][0] for a in alone])


def test_odd_documents(odd_docs, no_docs, model):
    texts = rows_of(odd_docs.select("doc_id", "text"))
    found = rows_of(language.predict(odd_docs, model))
    letters = sorted(repr(r["doc_id"]) for r in texts if not any(c.isalpha() for c in r["text"] or ""))
    assert sorted(repr(r["doc_id"]) for r in found if r["lang_pred"] == "und") == letters
    assert sum(r["held_out"] for r in found) == sum(r["doc_id"] is not None and remainder(r["doc_id"]) == 2 for r in texts)
    kept = language.keep_recognised(odd_docs, model, 0.0)
    assert kept.schema == odd_docs.schema and kept.count() == len(texts) - len(letters)
    assert language.predict(no_docs, model).count() == 0
    empty = language.fit(no_docs)
    assert {r["lang_pred"] for r in rows_of(language.predict(odd_docs, empty))} == {"und"}
    assert language.keep_recognised(odd_docs, empty, 0.5).count() == len(texts) - len(letters)
