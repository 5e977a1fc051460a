"""Token counts of documents under a unigram vocabulary, by dynamic programming over a trie.

The best segmentation of a word into pieces depends on its prefix only, so the distinct words of
a batch are sorted, which walks their trie in order: forward scores (best log probability and
its number of tokens) are computed once for each shared prefix, and the counts at the end of
every word are stored for the documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabquest.llm.shared import bounded, broadcast_file, documents_of, loaded, prepare, words_of

# What starts a word in the vocabulary.
WORD_START = "▁"
# Words whose counts a Python worker keeps.
KEPT_WORDS = 500_000


class Pieces:
    """Log probabilities of the pieces of a public vocabulary, by Zipf's law of their rank."""

    def __init__(self, content: bytes):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=content)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        norm = math.log(sum(1 / (rank + 1) for rank in range(len(ids))))
        self.scores = {model.id_to_piece(i): -math.log(rank + 1) - norm for rank, i in enumerate(ids)}
        self.longest = max(map(len, self.scores))
        # A character that no piece holds is written as its bytes; each is dearer than any piece.
        self.byte_score = -math.log(len(ids) + 1) - norm - 10.0


def trie_counts(words: list[str], pieces: Pieces) -> list[tuple[int, int]]:
    """(tokens, byte tokens among them) of the best segmentation of each word; words in sorted order.

    Of equal scores the one with fewer tokens, then the one with the longer last piece counts.
    """
    scores, longest, byte_score = pieces.scores, pieces.longest, pieces.byte_score
    best, tokens, byte_tokens = [0.0], [0], [0]
    previous, counts = "", []
    for word in words:
        depth = 0
        for depth, (a, b) in enumerate(zip(previous, word)):
            if a != b:
                break
        else:
            depth = min(len(previous), len(word))
        del best[depth + 1 :], tokens[depth + 1 :], byte_tokens[depth + 1 :]
        for end in range(depth + 1, len(word) + 1):
            n_bytes = len(word[end - 1].encode("utf-8", "surrogatepass"))
            top = best[end - 1] + n_bytes * byte_score
            n, fallback, single = tokens[end - 1] + n_bytes, byte_tokens[end - 1] + n_bytes, True
            for start in range(max(0, end - longest), end):
                score = scores.get(word[start:end])
                if score is not None:
                    score += best[start]
                    if score > top or (score == top and (tokens[start] + 1 < n or single)):
                        top, n, fallback, single = score, tokens[start] + 1, byte_tokens[start], False
            best.append(top)
            tokens.append(n)
            byte_tokens.append(fallback)
        counts.append((tokens[len(word)], byte_tokens[len(word)]))
        previous = word
    return counts


class Counter:
    """Counts of batches of texts; those of the first distinct words are kept."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.known = pieces, {}

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words of each text, and (tokens, byte tokens) of each text."""
        values, n_words = words_of(texts)
        coded = values.dictionary_encode()
        words = coded.dictionary.to_pylist()
        new = sorted(WORD_START + w for w in words if w not in self.known)
        found = {w[1:]: c for w, c in zip(new, trie_counts(new, self.pieces))}
        each = np.array([self.known.get(w) or found[w] for w in words], np.int64).reshape(-1, 2)
        if len(self.known) < KEPT_WORDS:
            self.known.update(found)
        index = coded.indices.to_numpy(zero_copy_only=False)
        ends = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(each[index], axis=0)])
        bounds = np.concatenate([[0], np.cumsum(n_words)])
        return n_words, np.diff(ends[bounds], axis=0)


def count_tokens(docs: DataFrame, vocabulary_file: str) -> DataFrame:
    """doc_id, n_words, n_tokens and n_byte_tokens (of characters outside the vocabulary) of every row.

    Pre-tokens are the words between ASCII white space, each with a word start before it.  A null
    or empty text has none; repeated rows and null doc_ids stay; an empty table gives no rows;
    other columns are ignored.
    """
    content = broadcast_file(prepare(docs.sparkSession), vocabulary_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = loaded("token counts", content.value, lambda c: Counter(Pieces(c)))
        for whole in batches:
            for batch in bounded(whole, "text"):
                n_words, n_tokens = count(batch.column("text"))
                columns = [batch.column("doc_id"), pa.array(n_words), pa.array(n_tokens[:, 0]), pa.array(n_tokens[:, 1])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_tokens", "n_byte_tokens"])

    return documents_of(docs).mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_byte_tokens long")
