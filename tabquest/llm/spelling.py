"""Spelling variants of a corpus's words, found with pivotal grams.

Words that differ by one inserted, deleted or replaced letter are near.  One edit touches at most
one of two bigrams that do not overlap.  So every word gets, in the order of how rare bigrams are
among the words, a prefix of its three rarest bigrams and two disjoint ones of these, its pivots, chosen
by dynamic programming to be as rare as possible together.  Of two near words, the one whose
prefix ends with the rarer bigram has a pivot that is left as it is in the other and lies in the
other's prefix.

Position limits: an edit behind the first pivot leaves the word as it is up to that pivot's end, any
other leaves it as it is from the second pivot on.  So prefixes are indexed by what stands up to the
end or from the start of each bigram, with the word's length, and pivots look up these two for the
three lengths that one edit can give.  Where that part is short, the letters are divided into three
classes; an edit leaves one of them as it is, which is looked up with it.  Every candidate is verified.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabquest.llm.shared import prepare, stored

# Letters of a run, and the capital letters that are folded.
LETTERS = r"A-Za-zÀ-ÿ"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Letters of the folded alphabet: a-z and U+00C0 to U+00FF; there are at most their square of bigrams.
MAX_BIGRAMS = (26 + 64) ** 2
# Bigrams of a prefix (bigram length times edits, and one) and pivots among them (edits and one).
PREFIX_GRAMS = 3
PIVOTS = 2
# A form has at least this many times the occurrences of its variant, so paths of forms are short.
RATIO = 10
# Letters that two words must share at one end to meet whatever their other letters are; classes of letters otherwise.
LONG_PART = 5
CLASSES = 3
GRAM_SCHEMA = "word string, n long, last long, letters long, pivots array<long>, prefix array<long>"


def word_counts(docs: DataFrame, least_letters: int = 7, least_count: int = 2, drop_every: int = 31) -> DataFrame:
    """``word`` and ``n`` of the words that occur at least ``least_count`` times in all texts.

    A word is a maximal run of letters with A-Z lower-cased.  Where ``drop_every`` divides the crc32 of
    ``doc_id:run``, the run loses the letter at that number modulo its length.
    """
    runs = F.regexp_extract_all(F.translate("text", CAPITALS, CAPITALS.lower()), F.lit(f"([{LETTERS}]{{{least_letters},}})"), F.lit(1))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % drop_every == 0, less).otherwise(F.col("run"))
    words = rows.select("run", h.alias("h")).select(word.alias("word")).where(F.length("word") >= least_letters)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def bigram_counts(words: DataFrame) -> dict[str, int]:
    """In how many places of distinct words each bigram occurs; the alphabet bounds their number."""
    letters = words.where(F.length("word") > 1).select(F.split("word", "").alias("letters"))
    grams = F.zip_with("letters", F.slice("letters", F.lit(2), F.size("letters")), lambda a, b: F.concat(a, b))
    counts = letters.select(F.explode(grams).alias("gram")).where("gram IS NOT NULL").groupBy("gram").agg(F.count("*").alias("n"))
    return {r["gram"]: r["n"] for r in counts.limit(MAX_BIGRAMS + 1).collect()}


def gram_prefix(word: str, order: dict[str, int], grams: int = PREFIX_GRAMS) -> list[tuple[int, int]]:
    """(rank, position) of the first bigrams of a word, rarest first and from left to right, by position.

    If the last of them stands again one place on, where an edit may have moved it, that belongs to it too.
    """
    ranked = [(order[word[i : i + 2]], i) for i in range(len(word) - 1)]
    first = sorted(ranked)[:grams]
    if first and first[-1][1] + 1 < len(ranked) and ranked[first[-1][1] + 1][0] == first[-1][0]:
        first.append(ranked[first[-1][1] + 1])
    return sorted(first, key=lambda r: r[1])


def choose_pivots(prefix: list[tuple[int, int]], weights: list[int], pivots: int = PIVOTS) -> list[tuple[int, int]]:
    """The ``pivots`` grams of a prefix (by position) that do not overlap and have the least total weight.

    ``best[k]`` holds the least weight of k disjoint grams among those looked at, and the grams; a
    gram extends what was best before any gram that it overlaps.
    """
    best: list[list[tuple]] = [[(0, ())] + [None] * pivots]
    for i, (rank, at) in enumerate(prefix):
        j = i
        while j and prefix[j - 1][1] > at - 2:
            j -= 1
        now = list(best[i])
        for k in range(1, pivots + 1):
            if best[j][k - 1] is not None:
                found = (best[j][k - 1][0] + weights[rank], (*best[j][k - 1][1], (rank, at)))
                if now[k] is None or found[0] < now[k][0]:
                    now[k] = found
        best.append(now)
    return list(best[-1][pivots][1]) if best[-1][pivots] else prefix


def letter_bits(word: str) -> int:
    """A bit for each letter (modulo 63), set if the word has it an odd number of times; one edit flips at most two."""
    bits = 0
    for c in word:
        bits ^= 1 << ord(c) % 63
    return bits


def letter_classes(counts: dict[str, int]) -> dict[str, int]:
    """Letters dealt into classes that occur about as often."""
    letters = Counter()
    for gram, n in counts.items():
        letters.update({gram[0]: n})
        letters.update({gram[1]: n})
    load, classes = [0] * CLASSES, {}
    for letter in sorted(letters, key=lambda c: (-letters[c], c)):
        classes[letter] = load.index(min(load))
        load[classes[letter]] += letters[letter]
    return classes


class Grams:
    """Prefix, pivots and places of words, from the bigram counts of all words."""

    def __init__(self, counts: dict[str, int]):
        ranked = sorted(counts, key=lambda g: (counts[g], g))
        self.order = {g: i for i, g in enumerate(ranked)}
        self.weights = [counts[g] for g in ranked]
        self.classes = letter_classes(counts)

    def _places(self, side: str, part: str, size: int, own: list[str]) -> Iterator[int]:
        """What stands at one end and the word's length, with the letters of a class where it is short."""
        key = f"{side}{size}:{part}"
        for name in [""] if len(part) >= LONG_PART else own:
            yield xxhash.xxh64_intdigest(key + name) - (1 << 63)

    def __call__(self, word: str) -> tuple[int, list[int], list[int]]:
        """Rank and position of the prefix's last bigram as one number, places that the pivots look up, places of the prefix."""
        prefix = gram_prefix(word, self.order)
        if len(prefix) < PIVOTS:
            return 0, [], []
        (_, first), (_, second) = choose_pivots(prefix, self.weights)
        classes = self.classes
        own = [f":{k}" + "".join(c for c in word if classes[c] == k) for k in range(CLASSES)]
        looked_up, places = [], []
        for size in range(len(word) - 1, len(word) + 2):
            looked_up += self._places("<", word[: first + 2], size, own)
            looked_up += self._places(">", word[second:], size, own)
        for _, at in prefix:
            places += self._places("<", word[: at + 2], len(word), own)
            places += self._places(">", word[at:], len(word), own)
        rank, at = sorted(prefix)[:PREFIX_GRAMS][-1]
        return rank << 32 | at, looked_up, places


def with_grams(words: DataFrame) -> DataFrame:
    """Words with the places of their pivots and of their prefix; the counts of all bigrams go to every task."""
    spark = prepare(words.sparkSession)
    counts = bigram_counts(words)
    if len(counts) > MAX_BIGRAMS:
        raise ValueError("words have letters beyond the alphabet")
    shared = spark.sparkContext.broadcast(counts)
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["word", "n", "last", "letters", "pivots", "prefix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(shared.value)
        for batch in batches:
            own = batch.column("word").to_pylist()
            last, pivots, prefix = zip(*map(grams, own)) if own else ((), (), ())
            columns = [own, batch.column("n"), last, [letter_bits(w) for w in own], pivots, prefix]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return words.select("word", "n").mapInArrow(run, GRAM_SCHEMA)


def near_words(grams: DataFrame) -> DataFrame:
    """``word``, ``n``, ``near`` and ``near_n`` for both orders of all pairs of near words; a pair may come repeatedly."""

    def side(name: str, places: str) -> DataFrame:
        own = [F.col(c).alias(f"{name}_{c}") for c in ("word", "n", "last", "letters")]
        return grams.select(*own, F.explode(places).alias(f"{name}_place"))

    near = (
        (F.col("a_last") <= F.col("b_last"))
        & (F.bit_count(F.col("a_letters").bitwiseXOR(F.col("b_letters"))) <= 2)
        & (F.col("a_word") != F.col("b_word"))
        & (F.levenshtein("a_word", "b_word", 1) == 1)
    )
    found = side("a", "pivots").join(side("b", "prefix"), (F.col("a_place") == F.col("b_place")) & near)
    order = [("a", "b"), ("b", "a")]
    names = ("word", "n")
    both = [
        F.struct(*[F.col(f"{x}_{c}").alias(c) for c in names], *[F.col(f"{y}_{c}").alias(o) for c, o in zip(names, ("near", "near_n"))])
        for x, y in order
    ]
    return found.select(F.inline(F.array(*both)))


def forms_of(near: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Per word with near ones: ``n_near``, and ``form`` and ``form_n`` where the most frequent near word has ``ratio`` times its count."""
    # A word has a bounded number of near ones, so that all of them may meet in one place.
    each = near.repartition("word").dropDuplicates(["word", "near"])
    top = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("form")))
    best = each.groupBy("word").agg(F.count("*").alias("n_near"), F.first("n").alias("n"), top.alias("top"))
    is_form = -F.col("top.order") >= ratio * F.col("n")
    return best.select("word", "n_near", F.when(is_form, F.col("top.form")).alias("form"), F.when(is_form, -F.col("top.order")).alias("form_n"))


def roots_of(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` of the words with a form: the last word on its path of forms.

    Every step multiplies the count by ``RATIO`` at least and every round doubles the steps taken, so
    counts below 2 ** 63 are done in five rounds.
    """
    found = forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(5):
        ahead = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        on = found.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        on = stored(on, "roots")
        found = on.select("word", "root")
        if on.where("moved").isEmpty():
            break
    return found


def variant_groups(docs: DataFrame, least_letters: int = 7, least_count: int = 2, ratio: int = RATIO, drop_every: int = 31) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the corpus.

    ``form`` is the near word with the most occurrences (of equal ones the first in code-point order), if it
    has ``ratio`` times the word's, else null; ``root`` is reached by following forms and is the word itself
    if there is none.  Null and empty texts have no words, a null doc_id counts as an empty one, repeated
    rows count as often as they occur; an empty table gives no rows; other columns are ignored.
    """
    prepare(docs.sparkSession)
    words = stored(word_counts(docs, least_letters, least_count, drop_every), "words")
    forms = stored(forms_of(near_words(stored(with_grams(words), "grams")), ratio), "forms")
    roots = roots_of(forms)
    return (
        words.join(forms, "word", "left")
        .join(roots, "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
    )
