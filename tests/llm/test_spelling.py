"""Spelling variants against all pairs of words in Python."""

import random
import re
import zlib
from collections import Counter

import pytest
from llm_helpers import SF_DIR, rows_of

from tabquest.llm import spelling
from tabquest.llm.queries import QUERIES

FOLD = {c: c + 32 for c in range(65, 91)}


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(words):
    """All pairs that agree without some one letter are looked at."""
    index = {}
    for w in words:
        for key in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            index.setdefault(key, []).append(w)
    near = {w: set() for w in words}
    for own in index.values():
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                if is_near(a, b):
                    near[a].add(b)
                    near[b].add(a)
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    found = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        found.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(found, key=repr)


def as_rows(df):
    return sorted(((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows_of(df)), key=repr)


def test_query_equals_all_pairs(spark, given):
    rows = [(r["doc_id"], r["text"]) for r in rows_of(given("documents").select("doc_id", "text"))]
    assert as_rows(QUERIES["op12_spelling"](spark, SF_DIR)) == plain_groups(plain_words(rows))


def noisy_words(rng, letters, n):
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 12))) for _ in range(n)]
    out = list(base)
    for w in base:
        for _ in range(6):
            i = rng.randrange(len(w))
            out.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]]))
    return out


@pytest.mark.parametrize("letters", ["ab", "abcdefghij", "éàabcß÷", "aaaaaaaaab"])
def test_near_words_of_few_letters(spark, letters):
    words = sorted(set(noisy_words(random.Random(letters), letters, 60)))
    found = spelling.near_words(spelling.with_grams(spark.createDataFrame([(w, 2) for w in words], "word string, n long")))
    pairs = {(r["word"], r["near"]) for r in rows_of(found)}
    assert pairs == {(a, b) for a in words for b in words if is_near(a, b)}


def test_forms_of_forms_and_ties(spark):
    counts = {"abcdefgh": 30_000, "abcdefg": 3_000, "abcdef": 0, "abcdefgx": 300, "abcdefgxy": 30, "abcdefgxyz": 3, "bbcdefgx": 300}
    counts |= {"mmmmmmmmm": 50, "nmmmmmmmm": 50, "ommmmmmmm": 5, "qqqqqqqqq": 7}
    text = " ".join(" ".join([w] * n) for w, n in counts.items())
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = as_rows(spelling.variant_groups(docs, drop_every=1 << 40))
    words = {w: n for w, n in counts.items() if n}
    assert [r for r in found if len(r[0]) >= 7] == [r for r in plain_groups({w: n for w, n in words.items() if len(w) >= 7})]
    assert {r[0]: r[2] for r in found}["abcdefgxyz"] == "abcdefgh"
    assert {r[0]: r[1] for r in found}["ommmmmmmm"] == "mmmmmmmmm"


def test_pivots_are_the_rarest_disjoint_pair():
    rng = random.Random(2)
    for _ in range(300):
        word = "".join(rng.choice("abcde") for _ in range(rng.randint(7, 14)))
        grams = sorted({word[i : i + 2] for i in range(len(word) - 1)})
        rng.shuffle(grams)
        weights = sorted(rng.randint(1, 50) for _ in grams)
        prefix = spelling.gram_prefix(word, {g: i for i, g in enumerate(grams)})
        chosen = spelling.choose_pivots(prefix, weights)
        pairs = [(a, b) for a in prefix for b in prefix if b[1] >= a[1] + 2]
        assert chosen[1][1] >= chosen[0][1] + 2
        assert sum(weights[r] for r, _ in chosen) == min(weights[a[0]] + weights[b[0]] for a, b in pairs)


def test_odd_documents(spark, odd_docs, no_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "n").unionByName(
        spark.createDataFrame([(None, "Wörter wörter", None, 1.0), (8, "A" * 30_000 + " " + "a" * 30_001, "x", 2.0), (8, "x" * 50_000, "y", 0.0)], "doc_id long, text string, lang string, n double")
    )
    rows = [(r["doc_id"], r["text"]) for r in rows_of(docs)]
    found = {r[0]: r[3] for r in as_rows(spelling.variant_groups(docs.unionByName(docs)))}
    assert found == plain_words(rows + rows)
    assert spelling.variant_groups(no_docs).count() == 0
