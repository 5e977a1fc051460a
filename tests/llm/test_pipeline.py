"""The pipeline on the smallest tables, each stage against brute force over its own input."""

import itertools
import random
import sys
from pathlib import Path

import numpy as np
import pytest
from llm_helpers import SF_DIR, rows_of
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402

from tabquest.llm import language, pii, simhash  # noqa: E402
from tabquest.llm.shared import stored  # noqa: E402


def ids(df):
    return sorted(r["doc_id"] for r in rows_of(df.select("doc_id")))


def shingles(text):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1)))


def smallest_of_similar(rows):
    """The smallest id of each group of texts with similar shingles, by all pairs."""
    sets = {}
    for i, text in rows:
        sets.setdefault(shingles(text), []).append(i)
    root = {s: s for s in sets}

    def top(s):
        while root[s] is not s:
            s = root[s]
        return s

    for a, b in itertools.combinations(sets, 2):
        if 10 * min(len(a), len(b)) >= 8 * max(len(a), len(b)) and 10 * len(a & b) >= 8 * len(a | b):
            root[top(a)] = top(b)
    groups = {}
    for s, own in sets.items():
        groups.setdefault(top(s), []).extend(own)
    return sorted(min(g) for g in groups.values())


def test_stages(spark, given):
    docs = given("documents")
    names = docs.columns
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, SF_DIR), name)
        after[name] = (before, docs)
        if name != "best_fit_packing":
            assert docs.columns == names and docs.schema == before.schema
    before, kept = after["language_id"]
    scores = rows_of(language.predict(before, language.fit(before)))
    assert ids(kept) == sorted(r["doc_id"] for r in scores if r["lang_pred"] != "und" and r["score"] >= 0.35)
    before, kept = after["simhash_near_dedup"]
    assert ids(kept) == smallest_of_similar([(r["doc_id"], r["text"]) for r in rows_of(before)])
    before, kept = after["benchmark_decontamination"]
    items = [r["text"] for r in rows_of(given("benchmark"))]
    assert ids(kept) == sorted(r["doc_id"] for r in rows_of(before) if not any(t in r["text"] for t in items))
    before, kept = after["pii_masking"]
    assert ids(kept) == ids(before)
    texts = {r["doc_id"]: r["text"] for r in rows_of(kept)}
    for r in rows_of(before):
        assert texts[r["doc_id"]] == pii.masked(r["text"], pii.find_spans(r["text"]))
    before, packed = after["best_fit_packing"]
    assert sorted({r["doc_id"] for r in rows_of(packed.select("doc_id"))}) == ids(before)
    whole = corpus_pipeline.run(spark, SF_DIR)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(columns).collect())) == sorted(map(tuple, packed.select(columns).collect()))


def test_near_copies_are_those_of_similar_shingles(spark, given):
    rng = random.Random(5)
    rows = [(r["doc_id"], r["text"]) for r in rows_of(given("documents").select("doc_id", "text"))]
    for k in range(30):  # few to many changed words, beside each other: similarities around 0.8; chains of copies
        words = [f"w{rng.randrange(5000)}" for _ in range(100)]
        for i in range(3):
            rows.append((10**6 + 10 * k + i, " ".join(words)))
            at = rng.randrange(80)
            words[at : at + 1 + k % 12] = [f"x{rng.randrange(5000)}" for _ in range(1 + k % 12)]
    rows += [(2 * 10**6 + i, t) for i, t in enumerate([None, "", " ", "one two", "One  two", "one"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = corpus_pipeline.simhash_near_dedup(spark, docs, SF_DIR)
    assert ids(found) == smallest_of_similar(rows)


def test_texts_of_one_template_are_not_compared_with_each_other(spark, monkeypatch):
    """2,000 texts of one template, similarities about 0.7, and 20 that differ from one of them in a word."""
    rng = random.Random(3)
    template = [f"t{i}" for i in range(120)]
    texts = [" ".join(template + [f"own{i}x{j}" for j in range(25)]) for i in range(2000)]
    near = [" ".join([*t.split()[:-1], "other"]) for t in rng.sample(texts, 20)]
    rows = list(enumerate(texts + near))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    prints = stored(simhash._shingled(simhash._keyed(docs), 5, 42, "shingles"), "prints").withColumn("root", F.col("fingerprint"))
    cells = stored(simhash.rare_cells(prints, 0.8).join(prints.select("fingerprint", "root"), "fingerprint"), "cells")
    per = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("early").alias("any")).where("any")
    compared = per.agg(F.sum(F.expr("n * (n - 1) / 2"))).first()[0]
    assert compared < 20 * len(rows)
    found = rows_of(simhash.candidate_pairs(cells, prints, 0.8))
    assert len({(r["a"], r["b"]) for r in found}) == 20
    kept = corpus_pipeline.simhash_near_dedup(spark, docs, SF_DIR)
    assert ids(kept) == list(range(2000))


@pytest.mark.parametrize("tile_rows", [3, 4096])
def test_candidates_hold_every_similar_pair(spark, tile_rows):
    """Random sets of shingles: crowded cells in tiles, every pair of different groups and similarity 0.8 is a candidate."""
    rng = random.Random(9)
    sets = []
    for _ in range(12):
        base = [rng.getrandbits(62) for _ in range(rng.randint(5, 60))]
        for _ in range(30):
            kept = [h for h in base if rng.random() > 0.08]
            sets.append(frozenset(kept + [rng.getrandbits(62) for _ in range(rng.randint(0, 4))]))
    sets = sorted(set(s for s in sets if s), key=sorted)
    rows = []
    for i, s in enumerate(sets):
        values = np.array(sorted(s), np.uint64)
        bits = simhash.fingerprints(values, np.array([len(values)])).view(np.int64)
        odd = simhash.parities(values, np.array([len(values)]))
        rows.append((i, [int(v) for v in values], int(bits[0]), odd.tobytes(), i // 2))
    table = spark.createDataFrame(rows, "fingerprint long, shingles array<long>, bits long, parity binary, root long")
    cells = simhash.rare_cells(table, 0.8).join(table.select("fingerprint", "root"), "fingerprint")
    found = {(r["a"], r["b"]) for r in rows_of(simhash.candidate_pairs(cells, table, 0.8, tile_rows=tile_rows))}
    expected = {
        (a, b) for a, b in itertools.combinations(range(len(sets)), 2)
        if a // 2 != b // 2 and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])
    }
    assert len(expected) > 100 and expected <= found
    differ = [len(sets[a] ^ sets[b]) / (len(sets[a]) + len(sets[b])) for a, b in found]
    assert sum(d > 0.15 for d in differ) < len(found) / 100  # similarity 0.74: parities tell them from 0.8
    one = {(r["a"], r["b"]) for r in rows_of(simhash.candidate_pairs(cells, table, 0.8, True, tile_rows=tile_rows))}
    assert one <= found and {(a // 2, b // 2) for a, b in one} == {(a // 2, b // 2) for a, b in found}


def test_tile_pairs_far_apart_in_bits_are_skipped(monkeypatch):
    compared = []
    monkeypatch.setattr(simhash, "_SQUARE", 8)
    monkeypatch.setattr(simhash, "_near", lambda a, b, r: compared.append((len(a), len(b))) or (np.zeros(0, int), np.zeros(0, int)))
    few = np.array([1 << i for i in range(8)], np.uint64)
    bits = np.concatenate([few, ~few])
    ids_ = np.arange(16)
    assert all(not len(a) for a, *_ in simhash.square_pairs((bits, ids_, ids_, ids_ + 9, ids_ * 0, np.zeros((16, 16), np.uint64)), None, 0.8, 26))
    assert len(compared) == 2  # each tile with itself, not with the other


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_with_odd_documents(spark, given, odd_docs, no_docs, k):
    name, stage = corpus_pipeline.STAGES[k]
    assert stage(spark, no_docs, SF_DIR).count() == 0
    found = stored(stage(spark, odd_docs, SF_DIR), name)
    assert found.count() > 0
    if k + 1 < len(corpus_pipeline.STAGES):
        assert found.columns == odd_docs.columns
