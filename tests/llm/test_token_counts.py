"""Token counts against plain dynamic programming over each word."""

import pyarrow as pa
import pytest
from hypothesis import given as for_all
from hypothesis import settings
from hypothesis import strategies as st
from llm_helpers import plain_words, rows_of

from tabquest.llm import token_counts
from tabquest.llm.shared import tokenizer_path

FILE = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return token_counts.Pieces(open(FILE, "rb").read())


def plain_count(word, pieces):
    """Best (score, fewest tokens, shortest start of the last piece) for every prefix, from the front."""
    best = [(0.0, 0, 0)]
    for end in range(1, len(word) + 1):
        size = len(word[end - 1].encode("utf-8", "surrogatepass"))
        score, n, fallback = best[end - 1]
        choice, whole = (score + size * pieces.byte_score, n + size, fallback + size), False
        for start in range(end):
            own = pieces.scores.get(word[start:end])
            if own is not None:
                made = (best[start][0] + own, best[start][1] + 1, best[start][2])
                if made[0] > choice[0] or (made[0] == choice[0] and (not whole or made[1] < choice[1])):
                    choice, whole = made, True
        best.append(choice)
    return best[-1][1:]


@settings(max_examples=300, deadline=None)
@for_all(st.lists(st.text(alphabet="theandrw▁é漢🙂.!-", min_size=1, max_size=14), max_size=20))
def test_shared_prefixes_change_nothing(pieces, words):
    words = sorted({token_counts.WORD_START + w for w in words})
    assert token_counts.trie_counts(words, pieces) == [plain_count(w, pieces) for w in words]


def test_prefixes_are_scored_once(pieces):
    looked_up = []

    class Scores(dict):
        def get(self, key, default=None):
            looked_up.append(key)
            return super().get(key, default)

    class Counted:
        scores, longest, byte_score = Scores(pieces.scores), pieces.longest, pieces.byte_score

    words = ["▁there", "▁thereby", "▁therefore"]
    token_counts.trie_counts(words, Counted)
    prefixes = {w[:end] for w in words for end in range(1, len(w) + 1)}
    assert len(looked_up) == sum(min(len(p), pieces.longest) for p in prefixes)


def test_documents(given, odd_docs, no_docs, pieces):
    for docs in (given("documents"), odd_docs):
        known, expected = {}, []
        for r in rows_of(docs.select("doc_id", "text")):
            words = ["▁" + w.decode() for w in plain_words(r["text"])]
            for w in words:
                if w not in known:
                    known[w] = plain_count(w, pieces) if len(w) < 1000 else None
            if all(known[w] for w in words):
                total = [sum(known[w][k] for w in words) for k in (0, 1)]
                expected.append((repr(r["doc_id"]), len(words), *total))
        found = {tuple([repr(r["doc_id"]), r["n_words"], r["n_tokens"], r["n_byte_tokens"]]) for r in rows_of(token_counts.count_tokens(docs, FILE))}
        assert set(expected) <= found
        assert token_counts.count_tokens(docs, FILE).count() == docs.count()
    assert token_counts.count_tokens(no_docs, FILE).count() == 0


def test_counts_beyond_the_kept_words(pieces, monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT_WORDS", 2)
    counter = token_counts.Counter(pieces)
    texts = pa.array(["the river", "a small river", "the end", ""], pa.string())
    first, again = counter(texts), counter(texts)
    assert first[0].tolist() == again[0].tolist() == [2, 3, 2, 0]
    assert first[1].tolist() == again[1].tolist()
