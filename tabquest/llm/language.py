"""Language identification: words first, backing off to shorter and shorter character n-grams.

A word that the model knows counts with its log frequency in each language.  An unknown one
counts with the mean log frequency of its known 4-grams; if it has none, of its 3-grams, and so on
down to single characters.  A document's language is the one with the highest mean.

The model is fitted on a bounded sample of labelled documents (about ``docs_per_language`` of each
of the ``MAX_LANGUAGES`` most frequent languages, chosen by a hash of doc_id); its size is bounded
by ``WORDS`` words and ``GRAMS`` n-grams of each length for each language, so it is broadcast.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabquest.llm.shared import bounded, kept, prepare, stored, words_of

MAX_LANGUAGES = 100
DOCS_PER_LANGUAGE = 2000
WORDS = 10_000
GRAMS = 5_000
LONGEST = 4
UNKNOWN = "und"
# Added to every count, so that a language without a word still has a frequency for it.
SMOOTHING = 0.5
# Words whose vectors a Python worker keeps.
_KEPT = 300_000

_RUNS = regex.compile(r"\p{L}+")


def held_out(doc_id: Column) -> Column:
    """Documents that the model never learns from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Model:
    """Log frequencies of words and n-grams: a matrix with a row for each and a column for each language."""

    def __init__(self, languages: list[str], rows: list[tuple[int, str, str, int]]):
        """``rows``: (length of n-gram or 0 for words, language, entry, count)."""
        self.languages = languages
        self.key = uuid.uuid4().hex
        place = {lang: i for i, lang in enumerate(languages)}
        self.places: dict[int, dict[str, int]] = {n: {} for n in range(LONGEST + 1)}
        parts, first = [], 0
        for n, places in self.places.items():
            own = [r for r in rows if r[0] == n]
            for _, _, entry, _ in own:
                places.setdefault(entry, first + len(places))
            counts = np.zeros((len(places), len(languages)))
            for _, lang, entry, count in own:
                counts[places[entry] - first, place[lang]] += count
            counts += SMOOTHING
            parts.append(np.log(counts / counts.sum(0)) if len(places) else counts)
            first += len(places)
        self.matrix = np.concatenate(parts)

    @property
    def tables(self) -> dict[int, dict[str, np.ndarray]]:
        """The vector of each entry, by length of n-gram (0 for words)."""
        return {n: {entry: self.matrix[row] for entry, row in places.items()} for n, places in self.places.items()}

    def rows(self, word: str) -> list[int]:
        """Rows whose mean stands for a run of lower-case letters; none if nothing in it is known."""
        known = self.places[0].get(word)
        if known is not None:
            return [known]
        padded = f" {word} "
        for n in range(LONGEST, 0, -1):
            places = self.places[n]
            found = [places[g] for g in [padded[i : i + n] for i in range(len(padded) - n + 1)] if g in places]
            if found:
                return found
        return []

    def vector(self, word: str) -> np.ndarray | None:
        rows = self.rows(word)
        return self.matrix[rows].mean(0) if rows else None

    def token_vectors(self, tokens: list[str]) -> np.ndarray:
        """Of what stands between white space: the sum over its runs of letters, how many count, any letter."""
        totals = np.zeros((len(tokens), len(self.languages) + 2))
        rows: list[int] = []
        owners: list[int] = []
        sizes: list[int] = []
        for i, token in enumerate(tokens):
            for run in _RUNS.findall(token.lower()):
                totals[i, -1] = 1
                found = self.rows(run)
                if found:
                    rows += found
                    owners.append(i)
                    sizes.append(len(found))
        if rows:
            size, owner = np.array(sizes), np.array(owners)
            means = np.add.reduceat(self.matrix[rows], np.cumsum(size) - size, axis=0) / size[:, None]
            np.add.at(totals[:, :-2], owner, means)
            np.add.at(totals[:, -2], owner, 1)
        return totals


class Predictor:
    """Languages of batches of texts; vectors of frequent words are kept."""

    def __init__(self, model: Model):
        self.model = model
        self.slots: dict[str, int] = {}
        self.kept = np.zeros((0, len(model.languages) + 2))

    def _vectors(self, tokens: list[str]) -> np.ndarray:
        slots = np.fromiter((self.slots.get(t, -1) for t in tokens), np.int64, len(tokens))
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            new = self.model.token_vectors([tokens[i] for i in missing])
            slots[missing] = len(self.kept) + np.arange(len(missing))
            vectors = np.concatenate([self.kept, new])
            room = max(0, min(_KEPT - len(self.kept), len(missing)))
            self.slots.update((tokens[i], int(slots[i])) for i in missing[:room])
            self.kept = vectors[: len(self.kept) + room]
            return vectors[slots]
        return self.kept[slots]

    def __call__(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score (the softmax of the mean log frequencies) of each text."""
        values, counts = words_of(texts)
        coded = values.dictionary_encode()
        vectors = self._vectors(coded.dictionary.to_pylist())
        totals = np.zeros((len(texts), len(self.model.languages) + 2))
        index = coded.indices.to_numpy(zero_copy_only=False)
        ends = np.cumsum(counts)
        for first in range(0, len(index), 500_000):
            last = min(first + 500_000, len(index))
            owner = np.searchsorted(ends, np.arange(first, last), side="right")
            heads = np.flatnonzero(np.diff(owner, prepend=-1))
            totals[owner[heads]] += np.add.reduceat(vectors[index[first:last]], heads, axis=0)
        lettered = totals[:, -1] > 0
        languages = self.model.languages
        if not languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        means = totals[:, :-2] / np.maximum(totals[:, -2:-1], 1)
        powers = np.exp(means - means.max(1, keepdims=True))
        best = powers.argmax(1)
        scores = np.where(lettered, powers.max(1) / powers.sum(1), 0.0)
        return [languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)], scores


def _grams(size: int) -> Column:
    """All n-grams of one size of the word in ``entry``, with a space at either end."""
    padded = F.concat(F.lit(" "), "entry", F.lit(" "))
    last = F.length("entry") + 3 - size
    found = F.transform(
        F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
        lambda i: F.struct(F.lit(size).alias("size"), F.substring(padded, i, F.lit(size)).alias("gram")),
    )
    return F.filter(found, lambda g: F.length(g["gram"]) == size)


def _predictor(model: Model) -> Predictor:
    """One per worker and model, so that tasks share the vectors that are kept."""
    return kept(model.key, lambda: Predictor(model))


def fit(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """Learn from text and lang of the documents that are not held out."""
    prepare(docs.sparkSession)
    learnable = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    )
    sizes = learnable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    if not sizes:
        return Model([], [])
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, docs_per_language / r["n"]))])
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    sample = learnable.where(chance < F.element_at(share, F.col("lang")))
    words = stored(
        sample.select("lang", F.explode(F.expr(r"regexp_extract_all(lower(text), '\\p{L}+', 0)")).alias("entry"))
        .groupBy("lang", "entry")
        .agg(F.count("*").alias("n")),
        "language-words",
    )
    grams = F.flatten(F.array(*[_grams(n) for n in range(1, LONGEST + 1)]))
    counted = (
        words.select("lang", "n", F.inline(grams))
        .groupBy("size", "lang", F.col("gram").alias("entry"))
        .agg(F.sum("n").alias("n"))
        .unionByName(words.select(F.lit(0).alias("size"), "lang", "entry", "n"))
    )
    order = Window.partitionBy("size", "lang").orderBy(F.desc("n"), "entry")
    most = F.when(F.col("size") == 0, WORDS).otherwise(GRAMS)
    top = counted.withColumn("place", F.row_number().over(order)).where((F.col("place") <= WORDS) & (F.col("place") <= most))
    rows = [(r["size"], r["lang"], r["entry"], r["n"]) for r in top.select("size", "lang", "entry", "n").collect()]
    return Model(sorted(r["lang"] for r in sizes), rows)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row.

    A null text, or one without a letter, gives ``und`` and score 0; so does every text if there
    was nothing to learn from.  Ties go to the language that sorts first.  Repeated rows stay, a
    null doc_id is kept (not held out), an empty table gives no rows, other columns are ignored.
    """
    shipped = prepare(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = _predictor(shipped.value)
        for whole in batches:
            for batch in bounded(whole, "text"):
                languages, scores = predictor(batch.column("text"))
                columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(languages, pa.string()), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_recognised(docs: DataFrame, model: Model, least_score: float) -> DataFrame:
    """Rows of ``docs``, unchanged, whose language is recognised with at least ``least_score``.

    Without a model only texts without a letter go.
    """
    shipped = prepare(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = _predictor(shipped.value)
        for whole in batches:
            for batch in bounded(whole, "text"):
                texts = pc.fill_null(batch.column("text"), "")
                if predictor.model.languages:
                    languages, scores = predictor(texts)
                    keep = [lang != UNKNOWN and score >= least_score for lang, score in zip(languages, scores)]
                else:
                    keep = [_RUNS.search(t) is not None for t in texts.to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
