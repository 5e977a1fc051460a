"""Classifier chains: scores and words recomputed by hand, held-out quality, out-of-fold inputs, odd input."""

import math
import re

import pytest
from llm_helpers import rows_of
from pyspark.sql import functions as F

from tabquest.llm import toxicity


@pytest.fixture(scope="module")
def made(spark):
    """Toxic documents hold rude words; all toxic ones are of low quality."""
    import random

    rng = random.Random(3)
    rows, labels = [], []
    for i in range(240):
        words = [f"word{rng.randint(0, 300)}" for _ in range(40)]
        low, toxic = int(i % 3 == 0), int(i % 6 == 0)
        words += ["spam", "buy"] * low + ["idiot", "scum"] * toxic
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, low, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame(labels, "doc_id long, low int, toxic int")


def test_held_out_rows(made):
    docs, labels = made
    training = labels.where("doc_id < 180")
    chain = toxicity.fit_chain(docs, training, ["low", "toxic"])
    found = {r["doc_id"]: r for r in rows_of(toxicity.score(docs, chain))}
    assert len(found) == 240
    right = [(found[i]["is_toxic"] == (i % 6 == 0), found[i]["is_low"] == (i % 3 == 0)) for i in range(180, 240)]
    assert sum(a for a, _ in right) >= 57 and sum(b for _, b in right) >= 57
    assert chain.categories == ["low", "toxic"]
    assert chain.links[1].model.numFeatures == len(chain.links[1].vocabulary) + 1  # words and the earlier category


def words(text):
    return {w for w in re.split(r"[\W\d_]+", text.lower()) if w}


def by_hand(chain, text):
    """Probabilities of the categories in order, each an input of the next."""
    found, earlier = words(text), []
    for link in chain.links:
        weights = link.model.coefficients.toArray()
        total = link.model.intercept + sum(w for word, w in zip(link.vocabulary, weights) if word in found)
        total += sum(w * p for w, p in zip(weights[len(link.vocabulary) :], earlier))
        earlier.append(1 / (1 + math.exp(-total)))
    return earlier


def test_scores_equal_the_chain_by_hand(made):
    docs, labels = made
    chain = toxicity.fit_chain(docs, labels, ["low", "toxic"])
    texts = {r["doc_id"]: r["text"] for r in rows_of(docs)}
    for r in rows_of(toxicity.score(docs, chain)):
        low, toxic = by_hand(chain, texts[r["doc_id"]])
        assert abs(r["p_low"] - low) < 1e-9 and abs(r["p_toxic"] - toxic) < 1e-9
        assert r["is_low"] == (r["p_low"] >= chain.links[0].threshold) and r["is_toxic"] == (r["p_toxic"] >= chain.links[1].threshold)
    assert chain.links[1].model.coefficients[len(chain.links[1].vocabulary)] > 0  # low quality speaks for toxic


def test_telling_words_by_hand(made):
    docs, labels = made
    rows = toxicity.training_rows(docs, labels, ["toxic"])
    known = [(set(r["__words"]), r["toxic"]) for r in rows_of(rows)]
    share = sum(c for _, c in known) / len(known)
    counts = {}
    for own, c in known:
        for w in own:
            n, n1 = counts.get(w, (0, 0))
            counts[w] = (n + 1, n1 + c)
    ranked = sorted((-((n1 - n * share) ** 2) / n, w) for w, (n, n1) in counts.items() if n >= toxicity.MIN_DOCUMENTS)
    assert toxicity.telling_words(rows, "toxic", share, 2) == [w for _, w in ranked[:2]] == ["idiot", "scum"]
    assert set(toxicity.telling_words(rows, "toxic", share)) == {w for _, w in ranked[: toxicity.FEATURES]}


def test_out_of_fold_probabilities_come_from_the_other_folds(made):
    docs, labels = made
    rows = toxicity.training_rows(docs, labels, ["low"])
    fold = rows.groupBy("__fold").count().orderBy("__fold").first()["__fold"]

    def found(changed):
        return {r["doc_id"]: (r["__fold"], r["p"]) for r in rows_of(toxicity._out_of_fold(changed, "low", [], "p"))}

    before = found(rows)
    # other labels of one fold change what the models of the other folds give, never what its own rows get
    after = found(rows.withColumn("low", F.when(F.col("__fold") == fold, 1 - F.col("low")).otherwise(F.col("low"))))
    assert set(before) == {r["doc_id"] for r in rows_of(docs)} == set(after)
    own = [i for i, (f, _) in before.items() if f == fold]
    assert own and all(abs(before[i][1] - after[i][1]) < 1e-6 for i in own)
    others = [i for i, (f, _) in before.items() if f != fold]
    assert sum(abs(before[i][1] - after[i][1]) > 1e-3 for i in others) > len(others) / 2
    link = toxicity._fit_link(rows.where(F.col("__fold") != fold), "low", [])
    alone = {r["doc_id"]: r["p"] for r in rows_of(link.probability(rows.where(F.col("__fold") == fold), [], "p"))}
    assert set(alone) == set(own) and all(abs(alone[i] - before[i][1]) < 1e-6 for i in own)


def test_training_rows_are_bounded(made):
    docs, labels = made
    assert toxicity.training_rows(docs, labels, ["toxic"], max_rows=60).count() < 120


def test_odd_input(spark, odd_docs, no_docs):
    schema = "doc_id long, toxic int, text string"
    labels = spark.createDataFrame([(1, 1, "x"), (4, 0, "x"), (4, 1, "x"), (None, 1, "x"), (7, None, "x"), (999, 1, "x")], schema)
    chain = toxicity.fit_chain(odd_docs, labels, ["toxic"])  # one class only: a constant
    found = rows_of(toxicity.score(odd_docs, chain))
    assert len(found) == odd_docs.count() and {r["p_toxic"] for r in found} == {1.0}
    nothing = toxicity.fit_chain(odd_docs, labels.where("false"), ["toxic"])
    assert {r["is_toxic"] for r in rows_of(toxicity.score(odd_docs, nothing))} == {False}
    assert toxicity.score(no_docs, chain).count() == 0


def test_given_documents(given):
    labels = given("labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = toxicity.fit_chain(given("documents"), labels, ["low_quality", "toxic"])
    scored = toxicity.score(given("documents"), chain).join(given("labels"), "doc_id")
    clean = scored.where("quality = 1 and toxic = 0")
    assert clean.where("is_toxic").count() <= 0.02 * clean.count() + 1
