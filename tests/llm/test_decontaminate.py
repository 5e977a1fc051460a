"""Retrieval against scoring every pair; planted items; odd input."""

import random

import numpy as np
import pyarrow as pa
from llm_helpers import rows_of

from tabquest.llm import decontaminate as d


def made(seed, n_items=60, n_words=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(n_words)]
    weights = [1 / (i + 1) for i in range(n_words)]
    items = [(i, " ".join(rng.choices(words, weights, k=rng.randint(3, 200))) + ". " + " ".join(rng.choices(words, weights, k=6))) for i in range(n_items)]
    return rng, words, weights, items


def test_walk_finds_all_above_the_threshold():
    rng, words, weights, items = made(3)
    index = d.Index(items)
    for _ in range(300):
        terms = sorted({index.term_ids[w] for w in rng.choices(words, weights, k=rng.randint(1, 80)) if w in index.term_ids})
        least = rng.choice([0.05, 0.2, 0.5])
        expected = [p for p, own in enumerate(index.weights) if sum(w for t, w in own.items() if t in terms) >= least]
        found = index.walk(list(terms), least - 1e-12)
        assert set(expected) <= set(found)
        assert all(sum(w for t, w in index.weights[p].items() if t in terms) >= least - 1e-9 for p in found)


def brute(index, text):
    """Every passage against every part, all terms scored."""
    words = [index.term_ids.get(t, -1) for t in d.terms_of(text)]
    hits = {}
    step = d.PASSAGE_WORDS // 2
    for first in range(0, max(1, len(words) - step), step):
        part_words = words[first : first + d.PASSAGE_WORDS]
        grams = {tuple(part_words[k : k + n]) for n in range(1, 6) for k in range(len(part_words) - n + 1)}
        for part, own in enumerate(index.weights):
            score = sum(w for t, w in own.items() if t in part_words)
            sides = [d.overlap(s, grams, grams) for s in index.texts[part]]
            if score >= d.LEAST_SCORE and min(sides) >= d.LEAST_OVERLAP:
                hits.setdefault(index.items[part], []).append(score)
    return {item: max(scores) for item, scores in hits.items()}


def test_matches_equal_brute_force():
    rng, words, weights, items = made(5)
    index = d.Index(items)
    texts = []
    for _ in range(120):
        text = rng.choices(words, weights, k=rng.randint(0, 500))
        if rng.random() < 0.5:
            at = rng.randint(0, len(text))
            planted = rng.choice(items)[1].replace(".", "").split()
            if rng.random() < 0.4 and len(planted) > 4:
                planted[rng.randrange(len(planted))] = "changed"
            text[at:at] = planted
        texts.append(" ".join(text))
    found = d.Matcher(index)(pa.array(texts, pa.string()))
    for text, hits in zip(texts, found):
        expected = brute(index, text)
        assert {h[0]: round(h[1], 9) for h in hits} == {k: round(v, 9) for k, v in expected.items()}
    assert sum(map(bool, found)) > 30


def test_what_is_set_aside_never_decides():
    rng, words, weights, items = made(9)
    index = d.Index(items)
    texts = pa.array([" ".join(rng.choices(words, weights, k=100)) + " " + t for _, t in items], pa.string())
    one, other = d.Matcher(index), d.Matcher(index)
    other.aside, other.spare = np.zeros(len(index.postings), bool), 0.0
    other.tops = np.append([p.top for p in index.postings], 0.0)
    assert one(texts) == other(texts)


def test_planted_items_are_found(given):
    items = {r["item_id"]: r["text"] for r in rows_of(given("benchmark"))}
    texts = {r["doc_id"]: r["text"] for r in rows_of(given("documents"))}
    found = {r["doc_id"]: {h["item_id"] for h in r["hits"]} for r in rows_of(d.find_contamination(given("documents"), given("benchmark")))}
    for doc_id, text in texts.items():
        planted = {i for i, t in items.items() if t in text}
        assert planted <= found[doc_id]
        assert planted or not found[doc_id]
    clean = {r["doc_id"] for r in rows_of(d.drop_contaminated(given("documents"), given("benchmark")))}
    assert clean == {i for i, hits in found.items() if not hits}


def test_shards_give_the_same(spark):
    rng, words, weights, items = made(11)
    texts = [(i, " ".join(rng.choices(words, weights, k=90)) + " " + t.replace(".", "")) for i, t in items]
    docs, benchmark = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    size = sum(len(t) for _, t in items)

    def scores(shard_bytes):
        assert len(list(d.index_shards(benchmark, shard_bytes))) == -(-size // shard_bytes)
        found = d.find_contamination(docs, benchmark, shard_bytes)
        return {(r["doc_id"], h["item_id"]): h["score"] for r in rows_of(found) for h in r["hits"]}

    one, seven = scores(size), scores(-(-size // 7))
    assert len(one) >= len(items) and set(one) == set(seven)
    assert all(abs(one[k] - seven[k]) < 1e-12 for k in one)
    index = d.Index(items)
    expected = {(i, k): v for i, t in texts for k, v in brute(index, t).items()}
    assert set(one) == set(expected) and all(abs(one[k] - expected[k]) < 1e-9 for k in one)


def test_odd_input(spark, odd_docs, no_docs):
    schema = "item_id long, text string, doc_id string"
    items = [(1, "one two", "x"), (2, None, "x"), (3, "", "x"), (None, "same text here again", "x"), (4, "same text here again", "x"), (4, "same text here again", "x")]
    benchmark = spark.createDataFrame(items, schema)
    found = rows_of(d.find_contamination(odd_docs, benchmark))
    assert len(found) == odd_docs.count()
    hit = {(r["doc_id"], h["item_id"]) for r in found for h in r["hits"] if r["doc_id"] is not None}
    assert (7, None) in hit and (8, None) in hit
    assert (5, 1) in hit and (6, 1) in hit and (7, 4) in hit and (8, 4) in hit
    kept = d.drop_contaminated(odd_docs, benchmark)
    assert kept.schema == odd_docs.schema and kept.count() == sum(not r["hits"] for r in found)
    nothing = spark.createDataFrame([], schema)
    assert d.drop_contaminated(odd_docs, nothing).count() == odd_docs.count()
    assert d.find_contamination(no_docs, benchmark).count() == 0
