"""Counts and measures against brute force; verdicts by bands."""

import math
import random
import re
from collections import Counter

import pytest
import sentencepiece
from llm_helpers import plain_words, rows_of
from pyspark.sql import functions as F

from tabquest.llm import fertility
from tabquest.llm.shared import tokenizer_path

FILE = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return sentencepiece.SentencePieceProcessor(model_file=FILE)


def brute(text, vocabulary):
    text = text or ""
    words = [w.decode() for w in plain_words(text)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if plain_words(line):
            duplicates += line in seen
            seen.add(line)
    ids = [i for w in words for i in vocabulary.encode(w)]
    n, times = len(ids), Counter(ids)
    entropy = -sum(c / n * math.log2(c / n) for c in times.values())
    chars = sum(map(len, words))
    return {
        "n_words": len(words),
        "word_chars": chars,
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": duplicates,
        "n_repeat_words": len(covered),
        "n_tokens": n,
        "chars_per_token": chars / max(n, 1),
        "byte_share": sum(vocabulary.is_byte(i) for i in ids) / max(n, 1),
        "token_entropy": abs(entropy) / math.log2(max(n, 2)),
    }


def test_counts_equal_brute_force(given, odd_docs, vocabulary):
    for docs in (given("documents"), odd_docs):
        found = rows_of(fertility.judge(docs, FILE))
        expected = [(repr(r["doc_id"]), brute(r["text"], vocabulary)) for r in rows_of(docs.select("doc_id", "text"))]

        def listed(rows):
            return sorted((i, [round(m[k], 9) for k in expected[0][1]]) for i, m in rows)

        assert listed((repr(r["doc_id"]), r) for r in found) == listed(expected)
        for r in found:
            assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
            assert not (r["base_failed"] and r["kept"])


def test_groups_and_verdicts(spark):
    plain = "the people of this town have always worked in the fields near the river and live in small houses"
    words = plain.split()
    rows = [(i, " ".join(words[i % 7 :] + words[: i % 7]) + f" number {i}", "en") for i in range(60)]
    rows += [(100, "QZXJ### VKWQ$$$ " * 2 + " ".join(f"X{i}Q%%%Z" for i in range(40)), "en")]
    rows += [(101, "漢字 " + " ".join(chr(0x4E00 + 97 * i) for i in range(40)), None), (102, None, None), (103, " ".join(words), None)]
    found = {r["doc_id"]: r for r in rows_of(fertility.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), FILE))}
    assert all(found[i]["kept"] for i in range(60))
    assert not found[100]["base_failed"] and not found[100]["kept"]
    assert found[101]["band_group"] == "script cjk" and found[102]["band_group"] == "none" and found[103]["band_group"] == "script latin"
    assert found[102]["base_failed"]


def test_clean_documents_are_kept(given):
    found = fertility.judge(given("documents"), FILE).join(given("labels"), "doc_id").where("quality = 1 and toxic = 0")
    fine = found.where(~F.col("base_failed"))
    assert fine.where("kept").count() == fine.count()


def test_bands_reject_low_quality(given):
    found = fertility.judge(given("documents"), FILE).join(given("labels"), "doc_id").where("quality = 0 and not base_failed")
    assert 2 * found.where("not kept").count() >= found.count() > 0


def test_entropy_is_compared_among_documents_about_as_long(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(400)]

    def text(n, of):
        return " ".join(rng.choice(words[:of]) for _ in range(n))

    rows = [(i, text(20, 400), "en") for i in range(60)] + [(100 + i, text(400, 400), "en") for i in range(60)]
    rows += [(1000, text(400, 100), "en")]
    found = {r["doc_id"]: r for r in rows_of(fertility.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), FILE))}
    assert not found[1000]["base_failed"] and not found[1000]["kept"]
    assert sum(not found[i]["kept"] for i in [*range(60), *range(100, 160)]) <= 2


def test_no_documents_and_no_lang(no_docs, odd_docs):
    assert fertility.judge(no_docs, FILE).count() == 0
    assert fertility.judge(odd_docs.drop("lang"), FILE).count() == odd_docs.count()
