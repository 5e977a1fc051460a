"""Ids of whole texts with public tokenizers, equal to the library's, at the cost of the distinct pieces.

Both vocabularies cut a text at every space that stands before something other than white
space, whatever surrounds it, so the ids of a text are those of its pieces in a row.  The
library encodes each distinct piece once per worker; texts with unusual spacing go to it whole.
"""

from __future__ import annotations

import os
import re
from itertools import chain

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one worker per core

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tabquest.llm.shared import MAX_KEPT_PIECES, PieceIds, loaded, spans_of

# Pieces that are handed to the library in one string.
_JOINED = 256
# Characters that the library encodes at once: what it returns takes over 100 bytes a token.
_ENCODED_CHARS = 200_000
# A space before other white space or at either end of a text; control and format characters count as well.
_ODD_SPACE = r"^ | $| [\pZ\pC]"
# Letters of Latin-1 with punctuation behind them.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
_CORE_AND_TAIL = r"^(?P<core>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[.,;:!?#$%&*]+)$"


def load_tokenizer(content: bytes):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(content.decode("utf-8"))
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return tokenizer


def _encode_each(tokenizer, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    found = [np.zeros(0, np.uint32)]
    counts = np.empty(len(pieces), np.int64)
    sizes = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
    first = 0
    while first < len(pieces):
        base = sizes[first - 1] if first else 0
        last = max(int(np.searchsorted(sizes, base + _ENCODED_CHARS, side="right")), first + 1)
        each = [e.ids for e in tokenizer.encode_batch_fast(pieces[first:last], add_special_tokens=False)]
        counts[first:last] = np.fromiter(map(len, each), np.int64, len(each))
        found.append(np.fromiter(chain.from_iterable(each), np.uint32, int(counts[first:last].sum())))
        first = last
    return np.concatenate(found), counts


def _cut(pieces: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Letters and the punctuation behind them, which no token spans; other pieces stay whole."""
    parts = pc.extract_regex(pieces, _CORE_AND_TAIL)
    cores = pc.coalesce(pc.struct_field(parts, "core"), pieces)
    return cores, pc.fill_null(pc.struct_field(parts, "tail"), "")


def _joined_spans(flat, first, second) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat ids, starts and counts of pieces that consist of two spans each."""
    starts = np.stack([first[0], second[0]], 1).ravel()
    counts = np.stack([first[1], second[1]], 1).ravel()
    each = first[1] + second[1]
    return flat[spans_of(starts, counts)], np.cumsum(each) - each, each


class WordEncoder:
    """For vocabularies that fold case and drop white space: any space separates pieces."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        size = tokenizer.get_vocab_size()
        # The last token of a run of letters carries the end-of-word suffix.
        self.ends = np.array([(tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.pieces = PieceIds(self._encode)

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        letters = np.fromiter((_LETTERS(p) is not None for p in pieces), bool, len(pieces))
        plain = [p for p, ok in zip(pieces, letters) if ok]
        other = [p for p, ok in zip(pieces, letters) if not ok]
        joined = [" ".join(plain[i : i + _JOINED]) for i in range(0, len(plain), _JOINED)]
        ids, _ = _encode_each(self.tokenizer, joined)
        other_ids, other_counts = _encode_each(self.tokenizer, other)
        counts, starts = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        counts[letters] = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        starts[letters] = np.cumsum(counts[letters]) - counts[letters]
        counts[~letters] = other_counts
        starts[~letters] = len(ids) + np.cumsum(other_counts) - other_counts
        return np.concatenate([ids, other_ids])[spans_of(starts, counts)], counts

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and how many each text has."""
        lists = pc.split_pattern(texts, " ")
        coded = lists.values.dictionary_encode()
        cores, tails = _cut(coded.dictionary)
        cores = pc.if_else(pc.not_equal(tails, ""), pc.utf8_lower(cores), cores)
        parts = pa.concat_arrays([cores, tails]).dictionary_encode()
        flat, starts, counts = self.pieces.find(parts.dictionary.to_pylist())
        part = parts.indices.to_numpy(zero_copy_only=False).reshape(2, -1)
        flat, starts, counts = _joined_spans(flat, (starts[part[0]], counts[part[0]]), (starts[part[1]], counts[part[1]]))
        index = coded.indices.to_numpy(zero_copy_only=False)
        each = counts[index]
        ids = flat[spans_of(starts[index], each)]
        ends = np.concatenate([[0], np.cumsum(each)])[np.asarray(lists.offsets)]
        return ids, np.diff(ends)


class ByteEncoder:
    """For byte-level vocabularies that keep a space with the word behind it."""

    def __init__(self, tokenizer, kept_pieces: int = MAX_KEPT_PIECES):
        self.tokenizer = tokenizer
        size = tokenizer.get_vocab_size()
        # In byte-level vocabularies the byte 0x20 is written as U+0120.
        self.spaced = np.array([(tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        self.pieces = PieceIds(self._encode, kept_pieces)

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = [" " + " ".join(pieces[i : i + _JOINED]) for i in range(0, len(pieces), _JOINED)]
        ids, _ = _encode_each(self.tokenizer, joined)
        heads = np.flatnonzero(self.spaced[ids])
        return ids, np.diff(heads, append=len(ids))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and how many each text has."""
        odd = pc.match_substring_regex(texts, _ODD_SPACE).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._regular(texts)
        whole, whole_counts = _encode_each(self.tokenizer, texts.filter(pa.array(odd)).to_pylist())
        ids, counts = self._regular(texts.filter(pa.array(~odd)))
        each = np.empty(len(odd), np.int64)
        starts = np.empty(len(odd), np.int64)
        each[odd], each[~odd] = whole_counts, counts
        starts[odd] = np.cumsum(whole_counts) - whole_counts
        starts[~odd] = len(whole) + np.cumsum(counts) - counts
        return np.concatenate([whole, ids])[spans_of(starts, each)], each

    def _regular(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        lists = pc.split_pattern(texts, " ")
        offsets = np.asarray(lists.offsets)
        firsts = offsets[:-1]
        coded = lists.values.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        behind = np.ones(len(index), bool)
        behind[firsts] = False
        used = np.zeros(len(coded.dictionary), bool)
        used[index[behind]] = True
        cores, tails = _cut(coded.dictionary.filter(pa.array(used)))
        cores, tails = cores.dictionary_encode(), tails.dictionary_encode()
        kept, core_starts, core_counts = self.pieces.find(cores.dictionary.to_pylist())
        more = tails.dictionary.to_pylist() + lists.values.take(pa.array(firsts)).to_pylist()
        more, more_counts = _encode_each(self.tokenizer, more)
        more_starts = len(kept) + np.cumsum(more_counts) - more_counts
        core, tail = cores.indices.to_numpy(zero_copy_only=False), tails.indices.to_numpy(zero_copy_only=False)
        pool = np.concatenate([kept, more])
        flat, starts, counts = _joined_spans(pool, (core_starts[core], core_counts[core]), (more_starts[tail], more_counts[tail]))
        place = np.cumsum(used) - 1
        start, each = np.empty(len(index), np.int64), np.empty(len(index), np.int64)
        start[behind], each[behind] = starts[place[index[behind]]], counts[place[index[behind]]]
        n_tails = len(tails.dictionary)
        start[firsts], each[firsts] = len(flat) + more_starts[n_tails:], more_counts[n_tails:]
        ids = np.concatenate([flat, pool])[spans_of(start, each)]
        ends = np.concatenate([[0], np.cumsum(each)])[offsets]
        return ids, np.diff(ends)


def word_encoder(content: bytes) -> WordEncoder:
    return loaded("word", content, lambda c: WordEncoder(load_tokenizer(c)))


def byte_encoder(content: bytes, kept_pieces: int = MAX_KEPT_PIECES) -> ByteEncoder:
    return loaded(f"byte {kept_pieces}", content, lambda c: ByteEncoder(load_tokenizer(c), kept_pieces))
