"""Quality rules from tokeniser fertility, beside plain counts of words, symbols and repeats.

A public vocabulary measures every document: characters per token, the share of byte-fallback
tokens, and the entropy of its tokens relative to the most that many tokens can have.  The
rejection bands come from the documents of a language (of a script where the language is not
given) that are about as long, since relative entropy falls with length and short texts scatter
more: quartiles of each measure, and a half-width that is a multiple of their distance.  Where too
few documents are about as long, all of the group give the band, widened for documents shorter than
the usual one.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabquest.llm.shared import PieceIds, bounded, broadcast_file, loaded, prepare, spans_of, stored, words_of

MEASURES = ("chars_per_token", "byte_share", "token_entropy")
# Interquartile ranges beyond the quartiles that are still accepted.
BAND_WIDTH = 2.5
# The least half-width of a band, for groups whose quartiles coincide: as a share of the median or, for the shares, as it is.
LEAST_WIDTH = {"chars_per_token": 0.05, "byte_share": 0.1, "token_entropy": 0.05}
# Documents are about as long if the logarithms of their words, in halves of a doubling, have the same whole part.
CLASSES_PER_DOUBLING = 2
# Documents that a class of lengths needs for bands of its own.
LEAST_CLASS = 50
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
_SYMBOLS = "[#*$%&|<>]"
# Groups whose bands are learned: rows beyond the quantile sketch's accuracy do not change them.
_ACCURACY = 10_000
MEASURE_SCHEMA = (
    "doc_id long, band_group string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, token_entropy double"
)


class PieceModel:
    """Ids of words in a public vocabulary; each word is encoded once per worker."""

    def __init__(self, content: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=content)
        self.size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.size)])
        self.pieces = PieceIds(self._encode)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.model.encode(words, num_threads=1)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.uint32, int(counts.sum())), counts


def script_of(word: str) -> str | None:
    """Script of the first letter of a word, as Unicode names it."""
    for c in word:
        if c.isalpha():
            return unicodedata.name(c, "UNKNOWN").split()[0].lower()
    return None


def repeated_windows(index: np.ndarray, counts: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Words of each text in windows of ``size`` words that the text holds twice or more."""
    owner = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(index))  # words from here to the text's end
    starts = np.flatnonzero(left >= size)
    if not len(starts):
        return np.zeros(len(counts), np.int64)
    base = int(index.max()) + 1
    key = owner[starts]
    for k in range(size):
        _, key = np.unique(key * base + index[starts + k], return_inverse=True)
    again = np.bincount(key)[key] > 1
    change = np.zeros(len(index) + 1, np.int64)
    np.add.at(change, starts[again], 1)
    np.add.at(change, starts[again] + size, -1)
    covered = np.cumsum(change[:-1]) > 0
    return np.bincount(owner[covered], minlength=len(counts))


def duplicate_lines(texts: pa.Array) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    lists = pc.split_pattern(texts, "\n")
    owner = np.repeat(np.arange(len(texts)), np.diff(np.asarray(lists.offsets)))
    full = pc.not_equal(pc.binary_length(pc.ascii_trim_whitespace(lists.values)), 0).to_numpy(zero_copy_only=False)
    coded = lists.values.dictionary_encode()
    key = owner * (len(coded.dictionary) + 1) + coded.indices.to_numpy(zero_copy_only=False)
    _, first = np.unique(key[full], return_index=True)
    lines = np.bincount(owner[full], minlength=len(texts))
    return lines - np.bincount(owner[full][first], minlength=len(texts))


def _measure(texts: pa.Array, model: PieceModel):
    values, counts = words_of(texts)
    coded = values.dictionary_encode()
    words = coded.dictionary
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)

    def total(per_word: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=per_word[index], minlength=len(texts)).astype(np.int64)

    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    flat, starts, each = model.pieces.find(words.to_pylist())
    word_ids = flat[spans_of(starts, each)]
    of_word = np.repeat(np.arange(len(words)), each)
    byte_tokens = np.bincount(of_word, weights=model.is_byte[word_ids], minlength=len(words))
    n_tokens = total(each)
    ids = flat[spans_of(starts[index], each[index])]
    pairs, times = np.unique(np.repeat(owner, each[index]) * model.size + ids, return_counts=True)
    whose = pairs // model.size
    part = times / n_tokens[whose]
    entropy = np.bincount(whose, weights=-part * np.log2(part), minlength=len(texts))
    some = np.maximum(n_tokens, 1)
    chars = total(lengths)
    return words, index, owner, {
        "n_words": counts.astype(np.int64),
        "word_chars": chars,
        "n_symbols": pc.count_substring_regex(texts, _SYMBOLS).to_numpy(zero_copy_only=False).astype(np.int64),
        "n_dup_lines": duplicate_lines(texts),
        "n_repeat_words": repeated_windows(index, counts),
        "n_tokens": n_tokens,
        "chars_per_token": chars / some,
        "byte_share": total(byte_tokens) / some,
        "token_entropy": np.abs(entropy) / np.log2(np.maximum(n_tokens, 2)),
    }


def _scripts(rows: np.ndarray, words: pa.Array, index: np.ndarray, owner: np.ndarray) -> dict[int, str | None]:
    """The script of most words, for the texts in ``rows``."""
    names = [script_of(w) for w in words.to_pylist()]
    kinds = sorted({n for n in names if n})
    code = np.array([kinds.index(n) if n else -1 for n in names])[index]
    found = {}
    for row in rows:
        own = code[np.searchsorted(owner, row) : np.searchsorted(owner, row, side="right")]
        own = own[own >= 0]
        found[int(row)] = kinds[int(np.bincount(own).argmax())] if len(own) else None
    return found


def measures(docs: DataFrame, vocabulary_file: str) -> DataFrame:
    """Counts and fertility measures of every row; ``band_group`` is its language, or else its script."""
    content = broadcast_file(prepare(docs.sparkSession), vocabulary_file)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded("fertility", content.value, PieceModel)
        for whole in batches:
            for batch in bounded(whole, "text", 8_000_000):
                words, index, owner, found = _measure(batch.column("text"), model)
                groups = [f"lang {x}" if x is not None else None for x in batch.column("lang").to_pylist()]
                unnamed = np.array([i for i, g in enumerate(groups) if g is None], np.int64)
                if len(unnamed):
                    for i, script in _scripts(unnamed, words, index, owner).items():
                        groups[i] = f"script {script}" if script else "none"
                columns = [batch.column("doc_id"), pa.array(groups, pa.string()), *map(pa.array, found.values())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "band_group", *found])

    return rows.mapInArrow(run, MEASURE_SCHEMA)


def _length_class():
    return F.floor(CLASSES_PER_DOUBLING * F.log2(F.greatest("n_words", F.lit(1)))).cast("int")


def bands(measured: DataFrame) -> DataFrame:
    """Quartiles of each measure over all documents of a group with at least MIN_WORDS words.

    ``classes`` has them for each class of lengths with LEAST_CLASS documents (null: none has).
    """
    quartiles = [
        F.percentile_approx(m, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(_ACCURACY)).alias(f"{m}_quartiles") for m in MEASURES
    ]
    usual = F.percentile_approx("n_words", F.lit(0.5), F.lit(_ACCURACY)).alias("usual_words")
    rows = measured.where(F.col("n_words") >= MIN_WORDS)
    per_class = rows.groupBy("band_group", _length_class().alias("length_class")).agg(*quartiles, F.count("*").alias("n"))
    own = F.struct("length_class", F.struct(*[f"{m}_quartiles" for m in MEASURES]))
    classes = per_class.where(F.col("n") >= LEAST_CLASS).groupBy("band_group").agg(F.map_from_entries(F.collect_list(own)).alias("classes"))
    return rows.groupBy("band_group").agg(*quartiles, usual).join(classes, "band_group", "left")


def judge(docs: DataFrame, vocabulary_file: str) -> DataFrame:
    """Counts, measures, ``base_failed`` and ``kept`` of every row.

    ``base_failed``: fewer than MIN_WORDS words, or over MAX_REPEAT_PERCENT percent of them in
    repeated windows.  ``kept``: not that, and all measures within the bands of the group's documents
    that are about as long.  A null text has no words and fails.  Repeated rows and null doc_ids stay; an empty table gives no
    rows; columns other than doc_id, text and lang are ignored.
    """
    measured = stored(measures(docs, vocabulary_file), "measures")
    learned = stored(bands(measured), "bands")  # its size is known then, so Spark broadcasts it while it is small
    joined = measured.join(learned, "band_group", "left")
    own = F.try_element_at("classes", _length_class())
    short = F.greatest(F.lit(1.0), F.sqrt(F.col("usual_words") / F.greatest("n_words", F.lit(1))))
    scatter = F.when(own.isNull(), short).otherwise(1.0)
    outside = F.lit(False)
    for m in MEASURES:
        q = F.coalesce(own[f"{m}_quartiles"], f"{m}_quartiles")
        least = LEAST_WIDTH[m] * (q[1] if m == "chars_per_token" else F.lit(1.0))
        width = F.greatest((q[2] - q[0]) * BAND_WIDTH, least) * scatter
        outside = outside | (F.col(m) < q[0] - width) | (F.col(m) > q[2] + width)
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return joined.withColumn("base_failed", base_failed).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~F.coalesce(outside, F.lit(False))).alias("kept"),
        "n_tokens",
        *MEASURES,
        "band_group",
    )
