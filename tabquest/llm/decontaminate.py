"""Benchmark decontamination: every training passage queries a BM25 index of the test items.

Items are cut into parts of at most ``PART_WORDS`` words, so that a passage of ``PASSAGE_WORDS``
words, taken every half passage, holds any part whole.  A term's BM25 weight is divided by the sum of
its part's weights: a score is the share of a part that the passage covers, and all parts with
at least ``LEAST_SCORE`` are retrieved.

Retrieval is exact.  Terms that fill most passages are set aside, as long as they make up less
than ``SET_ASIDE`` of any part; a passage whose other terms cannot reach the rest together is done
at once.  For the others, block-max WAND walks the posting lists of the rarer terms, and what it
finds is scored in full.  At last the retrieved parts' word 5-grams are looked up in the passage:
the question (all but the last sentence) and the answer (the last one) must both overlap.

The index is broadcast.  Its items are read in shards of about ``SHARD_BYTES`` bytes of text, and a
benchmark of many shards is matched shard by shard.  Document frequencies and the average length are
counted by Spark over all parts of the benchmark, so scores do not depend on the shards.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabquest.llm.shared import bounded, prepare, release, spans_of, stored, words_of

PART_WORDS = 128
PASSAGE_WORDS = 2 * PART_WORDS
LEAST_SCORE = 0.6
SET_ASIDE = 0.45
LEAST_OVERLAP = 0.5
SHINGLE = 5
SHARD_BYTES = 16 * 1024 * 1024
K1, B = 1.2, 0.75
_BLOCK = 32
_RUN = re.compile(r"\w+")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
HIT_TYPE = "array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double>>"
_ARROW_HITS = pa.list_(
    pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])
)


def terms_of(text: str) -> list[str]:
    return _RUN.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of all sentences but the last, and of the last; halves of a single sentence."""
    sentences = [w for w in map(terms_of, _SENTENCE_END.split(text.strip())) if w]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = sentences[0] if sentences else []
    return words[: (len(words) + 1) // 2], words[(len(words) + 1) // 2 :]


def parts_of(text: str) -> list[tuple[list[str], list[str]]]:
    """Question and answer words of each part of an item that has any."""
    question, answer = question_and_answer(text)
    words = [(w, 0) for w in question] + [(w, 1) for w in answer]
    step = PART_WORDS // 2 if len(words) > PART_WORDS else PART_WORDS
    parts = []
    for first in range(0, max(1, len(words) - (PART_WORDS - step)), step):
        sides: tuple[list[str], list[str]] = ([], [])
        for word, side in words[first : first + PART_WORDS]:
            sides[side].append(word)
        if sides[0] or sides[1]:
            parts.append(sides)
    return parts


@dataclass
class Statistics:
    """Of all parts: how many there are, their words, and how many hold each of the terms at hand."""

    parts: int
    words: int
    frequency: dict[str, int]


def statistics_of(texts: Iterable[str]) -> Statistics:
    """Counted over the given items."""
    found = Statistics(0, 0, Counter())
    for text in texts:
        for question, answer in parts_of(text):
            found.parts += 1
            found.words += len(question) + len(answer)
            found.frequency.update({*question, *answer})
    return found


class _Postings:
    """Parts that hold a term, ascending, with weights, and the highest weight of each block."""

    __slots__ = ("parts", "weights", "ends", "highest", "top")

    def __init__(self, entries: list[tuple[int, float]]):
        entries.sort()
        self.parts = [p for p, _ in entries]
        self.weights = [w for _, w in entries]
        starts = range(0, len(entries), _BLOCK)
        self.ends = [self.parts[min(s + _BLOCK, len(entries)) - 1] for s in starts]
        self.highest = [max(self.weights[s : s + _BLOCK]) for s in starts]
        self.top = max(self.highest)


class Index:
    """BM25 index over the parts of test items; without ``statistics`` these are all of the benchmark."""

    def __init__(self, items: list[tuple[int | None, str]], statistics: Statistics | None = None):
        counted = statistics or statistics_of(text for _, text in items)
        self.term_ids: dict[str, int] = {}
        self.items: list[int | None] = []
        self.texts: list[tuple[list[int], list[int]]] = []  # question and answer words of each part
        for item_id, text in items:
            for sides in parts_of(text):
                self.items.append(item_id)
                self.texts.append(tuple([self.term_ids.setdefault(w, len(self.term_ids)) for w in side] for side in sides))
        counts = [Counter(q + a) for q, a in self.texts]
        inverse = [math.log(1 + (counted.parts - n + 0.5) / (n + 0.5)) for n in (counted.frequency[w] for w in self.term_ids)]
        average = counted.words / max(1, counted.parts)
        self.weights: list[dict[int, float]] = []
        for c in counts:
            length = K1 * (1 - B + B * sum(c.values()) / average)
            own = {t: inverse[t] * n * (K1 + 1) / (n + length) for t, n in c.items()}
            total = sum(own.values())
            self.weights.append({t: w / total for t, w in own.items()})
        entries: dict[int, list] = defaultdict(list)
        for part, own in enumerate(self.weights):
            for t, w in own.items():
                entries[t].append((part, w))
        self.postings = [_Postings(entries[t]) for t in range(len(self.term_ids))]

    def set_aside(self, often: np.ndarray) -> tuple[np.ndarray, float]:
        """Terms that need not be walked, the most frequent in passages first, and what they may add."""
        aside = np.zeros(len(self.postings), bool)
        filled = [0.0] * len(self.items)
        for t in np.argsort(-often, kind="stable"):
            own = self.postings[t]
            if all(filled[p] + w < SET_ASIDE for p, w in zip(own.parts, own.weights)):
                aside[t] = True
                for p, w in zip(own.parts, own.weights):
                    filled[p] += w
        return aside, max(filled, default=0.0)

    def walk(self, terms: list[int], least: float) -> list[int]:
        """Block-max WAND: parts to which the terms' weights add up to at least ``least``."""
        lists = [[self.postings[t], 0, 0] for t in terms]  # postings, position, block
        found = []
        while lists:
            lists.sort(key=lambda x: x[0].parts[x[1]])
            bound, pivot = 0.0, -1
            for k, (own, _, _) in enumerate(lists):
                bound += own.top
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            part = lists[pivot][0].parts[lists[pivot][1]]
            while pivot + 1 < len(lists) and lists[pivot + 1][0].parts[lists[pivot + 1][1]] == part:
                pivot += 1
            bound, reach = 0.0, math.inf
            for entry in lists[: pivot + 1]:
                own, _, block = entry
                while block < len(own.ends) and own.ends[block] < part:
                    block += 1
                entry[2] = block
                if block < len(own.ends):
                    bound += own.highest[block]
                    reach = min(reach, own.ends[block] + 1)
            if bound >= least:
                target = part + 1
                if lists[0][0].parts[lists[0][1]] == part:
                    if sum(own.weights[at] for own, at, _ in lists[: pivot + 1]) >= least:
                        found.append(part)
                else:
                    target = part
            else:  # no part before the next block or the next list can reach it
                target = max(part + 1, reach)
                if pivot + 1 < len(lists):
                    target = max(part + 1, min(target, lists[pivot + 1][0].parts[lists[pivot + 1][1]]))
            for entry in lists[: pivot + 1]:
                own, at, block = entry
                while block < len(own.ends) and own.ends[block] < target:
                    block += 1
                    at = max(at, min(block * _BLOCK, len(own.parts)))
                while at < len(own.parts) and own.parts[at] < target:
                    at += 1
                entry[1], entry[2] = at, min(at // _BLOCK, len(own.ends))
            lists = [e for e in lists if e[1] < len(e[0].parts)]
        return found


def overlap(words: list[int], passage: set[tuple[int, ...]], text: set[tuple[int, ...]]) -> float:
    """Share of the words' 5-grams that the passage holds; fewer words count as one sequence."""
    if not words:
        return 1.0
    if len(words) < SHINGLE:
        return float(tuple(words) in text)
    grams = [tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]
    return sum(g in passage for g in grams) / len(grams)


class Matcher:
    """Finds the items that texts of a batch contain."""

    def __init__(self, index: Index):
        self.index = index
        self.known: dict[str, tuple[int, ...]] = {}
        self.aside: np.ndarray | None = None

    def _runs(self, token: str) -> tuple[int, ...]:
        return tuple(self.index.term_ids.get(t, -1) for t in terms_of(token))

    def __call__(self, texts: pa.Array) -> list[list[tuple[int, float, float, float]]]:
        index = self.index
        found: list[list[tuple]] = [[] for _ in range(len(texts))]
        values, counts = words_of(texts)
        if not index.items or not len(values):
            return found
        coded = values.dictionary_encode()
        runs = [self._runs(t) for t in coded.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        pool = np.fromiter((t for r in runs for t in r), np.int64, int(sizes.sum()))
        place = coded.indices.to_numpy(zero_copy_only=False)
        terms = pool[spans_of((np.cumsum(sizes) - sizes)[place], sizes[place])]
        ends = np.concatenate([[0], np.cumsum(sizes[place])])[np.concatenate([[0], np.cumsum(counts)])]
        if self.aside is None:  # decides what is walked, never what is found
            often = np.bincount(terms[terms >= 0], minlength=len(index.postings))
            self.aside, self.spare = index.set_aside(often)
            tops = np.array([p.top for p in index.postings])
            self.tops = np.append(np.where(self.aside, 0.0, tops), 0.0)  # the last for unknown words
        bounds = np.concatenate([[0.0], np.cumsum(self.tops[terms])])
        least = LEAST_SCORE - self.spare - 1e-9
        step = PASSAGE_WORDS // 2
        n_words = np.diff(ends)
        n_passages = np.maximum(1, -(-(n_words - step) // step))
        owner = np.repeat(np.arange(len(texts)), n_passages)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(n_passages) - n_passages, n_passages)
        starts = ends[owner] + nth * step
        stops = np.minimum(starts + PASSAGE_WORDS, ends[owner + 1])
        for i in np.flatnonzero(bounds[stops] - bounds[starts] >= least):
            words = terms[starts[i] : stops[i]].tolist()
            held = set(words)
            held.discard(-1)
            walked = [t for t in held if not self.aside[t]]
            parts = index.walk(walked, least)
            scored = [(p, sum(w for t, w in index.weights[p].items() if t in held)) for p in parts]
            scored = [(p, s) for p, s in scored if s >= LEAST_SCORE]
            if scored:
                grams = {tuple(words[k : k + SHINGLE]) for k in range(len(words) - SHINGLE + 1)}
                short = {tuple(words[k : k + n]) for n in range(1, SHINGLE) for k in range(len(words) - n + 1)}
                for part, score in scored:
                    question, answer = (overlap(side, grams, short) for side in index.texts[part])
                    if question >= LEAST_OVERLAP and answer >= LEAST_OVERLAP:
                        found[owner[i]].append((index.items[part], score, question, answer))
        return [_best(hits) for hits in found]


def _best(hits: list[tuple]) -> list[tuple]:
    """One hit for each item, the one with the highest score; by item, null last."""
    best: dict = {}
    for hit in sorted(hits, key=lambda h: h[1:]):
        best[hit[0]] = hit
    return [best[k] for k in sorted(best, key=_item_order)]


def _item_order(item_id: int | None) -> tuple[bool, int]:
    return item_id is None, item_id or 0


def _with_terms(items: DataFrame) -> DataFrame:
    """``shard``, ``kind`` and ``term`` with ``n``: parts that hold a term ('t'), parts ('p') and words ('w'), per slice of the items."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: dict[int, list[str]] = defaultdict(list)
            for shard, text in zip(batch.column("shard").to_pylist(), batch.column("text").to_pylist()):
                texts[shard].append(text)
            for shard, own in texts.items():
                found = statistics_of(own)
                rows = [("p", "", found.parts), ("w", "", found.words), *(("t", w, n) for w, n in found.frequency.items())]
                kinds, terms, counts = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(rows), pa.int64()), pa.array(kinds), pa.array(terms, pa.string()), pa.array(counts, pa.int64())],
                    ["shard", "kind", "term", "n"],
                )

    return items.select("shard", "text").mapInArrow(count, "shard long, kind string, term string, n long")


def index_shards(benchmark: DataFrame, shard_bytes: int = SHARD_BYTES) -> Iterator[Index]:
    """Indexes over the items, each of about ``shard_bytes`` bytes of text; items without words are left out.

    Terms are counted over the whole benchmark; each shard gets the counts of its own terms.  Items
    with a null id are searched like others and count as one item, whose id is null.
    """
    prepare(benchmark.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").rlike(r"\w")).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = -(-total // shard_bytes)
    if not shards:
        return
    items = stored(items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))), "items")
    terms = stored(_with_terms(items).groupBy("shard", "kind", "term").agg(F.sum("n").alias("n")), "terms")
    totals = {r["kind"]: r["n"] for r in terms.where("kind <> 't'").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    frequency = terms.where("kind = 't'").groupBy("term").agg(F.sum("n").alias("n"))
    of_shards = stored(terms.where("kind = 't'").select("shard", "term").join(frequency, "term"), "frequencies")
    for k in range(shards):
        rows = items.where(F.col("shard") == k).collect()
        if not rows:
            continue
        own = {r["term"]: r["n"] for r in of_shards.where(F.col("shard") == k).collect()}
        texts = sorted(((r["item_id"], r["text"]) for r in rows), key=lambda x: (_item_order(x[0]), x[1]))
        yield Index(texts, Statistics(totals.get("p", 0), totals.get("w", 0), own))


def _matching(docs: DataFrame, index: Index, keep_clean: bool) -> DataFrame:
    """With ``keep_clean`` the rows without a hit, unchanged; else hits are added to column ``hits``."""
    shipped = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        matcher = Matcher(shipped.value)
        for whole in batches:
            for batch in bounded(whole, "text"):
                hits = matcher(pc.fill_null(batch.column("text"), ""))
                if keep_clean:
                    yield batch.filter(pa.array([not h for h in hits], pa.bool_()))
                else:
                    names = ("item_id", "score", "question_overlap", "answer_overlap")
                    before = batch.column("hits").to_pylist()
                    both = [b + [dict(zip(names, x)) for x in h] for b, h in zip(before, hits)]
                    at = batch.schema.get_field_index("hits")
                    yield batch.set_column(at, "hits", pa.array(both, _ARROW_HITS))

    return docs.mapInArrow(run, docs.schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id and ``hits`` (item_id, score and overlaps of each test item found), per row of ``docs``.

    Null and empty texts have no hits; nor has any text if the benchmark is empty.  Items with
    equal text are all reported; those with a null id are reported once, with a null item_id.  Repeated rows and null doc_ids stay; other columns are ignored.
    """
    prepare(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.array().cast(HIT_TYPE).alias("hits"),
    )
    for index in index_shards(benchmark, shard_bytes):
        rows = _matching(rows, index, keep_clean=False)
    return rows.select("doc_id", "hits")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Rows of ``docs``, with all their columns, that contain no test item."""
    prepare(docs.sparkSession)
    for index in index_shards(benchmark, shard_bytes):
        docs = _matching(docs, index, keep_clean=True)
    return docs
