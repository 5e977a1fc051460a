"""Toxicity by classifier chains: categories one after the other, later ones with earlier probabilities.

Each category has a linear model over the words that tell it best and over the probabilities of the
categories before it.  For training, those probabilities are out-of-fold: each row's comes from
a model (and a choice of words) that has not seen the row.  They also give the category's threshold,
the one with the best F1.  Scoring uses models fitted on all training rows.  The training rows
are a bounded sample (about ``MAX_TRAINING_ROWS``, chosen by a hash of doc_id) of the labelled documents.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabquest.llm.shared import documents_of, prepare, stored

MAX_TRAINING_ROWS = 20_000
FOLDS = 3
# Words of a category's model, and documents that a word must be in to be one.
FEATURES = 2000
MIN_DOCUMENTS = 3
REGULARISATION = 0.001
ITERATIONS = 25
# Steps in which thresholds are tried.
STEPS = 200


@dataclass
class Link:
    """One category's model; a category with a single class in training has its share instead."""

    category: str
    model: object = None
    vocabulary: list[str] = field(default_factory=list)
    constant: float = 0.0
    threshold: float = 0.5

    def probability(self, rows: DataFrame, earlier: list[str], output: str) -> DataFrame:
        """``rows`` with the category's probability in ``output``."""
        if self.model is None:
            return rows.withColumn(output, F.lit(self.constant))
        scored = self.model.transform(_inputs(rows, self.vocabulary, earlier))
        return scored.withColumn(output, vector_to_array("__probability")[1]).drop(
            "__found", "__inputs", "__probability", "__raw", "__predicted"
        )


@dataclass
class Chain:
    links: list[Link] = field(default_factory=list)

    @property
    def categories(self) -> list[str]:
        return [link.category for link in self.links]


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.col(text)), r"[^\p{L}]+"), "")


def _inputs(rows: DataFrame, vocabulary: list[str], earlier: list[str]) -> DataFrame:
    found = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="__words", outputCol="__found", minTF=1.0)
    found.setBinary(True)
    return VectorAssembler(inputCols=["__found", *earlier], outputCol="__inputs").transform(found.transform(rows))


def telling_words(rows: DataFrame, category: str, share: float, n: int = FEATURES) -> list[str]:
    """The ``n`` words whose documents' classes differ most from the overall share (chi-square)."""
    counts = (
        rows.select(F.col(category).alias("c"), F.explode(F.array_distinct("__words")).alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("n"), F.sum("c").alias("n1"))
        .where(F.col("n") >= MIN_DOCUMENTS)
    )
    away = F.col("n1") - F.col("n") * share
    top = counts.orderBy(F.desc(away * away / F.col("n")), "word").limit(n)
    return [r["word"] for r in top.select("word").collect()]


def _fit_link(rows: DataFrame, category: str, earlier: list[str]) -> Link:
    known = rows.where(F.col(category).isNotNull())
    counts = {r[category]: r["n"] for r in known.groupBy(category).agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    vocabulary = telling_words(known, category, share) if len(counts) == 2 else []
    if not vocabulary:
        return Link(category, constant=share)
    regression = LogisticRegression(
        featuresCol="__inputs",
        labelCol=category,
        probabilityCol="__probability",
        rawPredictionCol="__raw",
        predictionCol="__predicted",
        regParam=REGULARISATION,
        maxIter=ITERATIONS,
        standardization=False,
    )
    return Link(category, regression.fit(_inputs(known, vocabulary, earlier)), vocabulary)


def _threshold(rows: DataFrame, category: str, probability: str) -> float:
    """The threshold with the best F1 over out-of-fold probabilities; a count for each step comes here."""
    step = F.floor(F.col(probability) * STEPS).cast("int")
    counts = rows.where(F.col(category).isNotNull()).groupBy(step.alias("step"), category).agg(F.count("*").alias("n"))
    hits, misses = [0] * (STEPS + 1), [0] * (STEPS + 1)
    for r in counts.collect():
        (hits if r[category] else misses)[r["step"]] += r["n"]
    positives = sum(hits)
    scores = [
        (2 * sum(hits[s:]) / max(1, sum(hits[s:]) + sum(misses[s:]) + positives), s / STEPS) for s in range(1, STEPS)
    ]
    best = max(f1 for f1, _ in scores)
    even = [t for f1, t in scores if f1 == best]
    return even[len(even) // 2] if positives else 0.5


def training_rows(docs: DataFrame, labels: DataFrame, categories: list[str], max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """Words, fold and 0/1 columns of the categories of a bounded sample of the labelled documents."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.max(c).cast("int").alias(c) for c in categories])
    n = known.count()
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    sample = known.where(chance < min(1.0, max_rows / max(n, 1)))  # small: its size is the bound
    joined = documents_of(docs).join(F.broadcast(sample), "doc_id")
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")
    return stored(joined.withColumn("__words", _words("text")).drop("text").withColumn("__fold", fold), "training")


def _out_of_fold(rows: DataFrame, category: str, earlier: list[str], output: str) -> DataFrame:
    parts = None
    for fold in range(FOLDS):
        link = _fit_link(rows.where(F.col("__fold") != fold), category, earlier)
        part = link.probability(rows.where(F.col("__fold") == fold), earlier, output)
        parts = part if parts is None else parts.unionByName(part)
    return stored(parts, "out-of-fold")


def fit_chain(docs: DataFrame, labels: DataFrame, categories: list[str], max_rows: int = MAX_TRAINING_ROWS) -> Chain:
    """Fit the chain; ``labels`` has doc_id and a 0/1 column for each category (null: not known).

    Repeated labels of a document count as 1 if any is 1.  A category without both classes gets
    its share as a constant probability; so do all if nothing is labelled.
    """
    prepare(docs.sparkSession)
    rows = training_rows(docs, labels, categories, max_rows).cache()
    chain, earlier = Chain(), []
    for k, category in enumerate(categories):
        link = _fit_link(rows, category, earlier)
        output = f"__p{k}"
        before, rows = rows, _out_of_fold(rows, category, earlier, output).cache()
        link.threshold = _threshold(rows, category, output)
        before.unpersist()
        chain.links.append(link)
        earlier = [*earlier, output]
    rows.unpersist()
    return chain


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id and, for each category c, ``p_c`` and the decision ``is_c``, of every row.

    A null or empty text has no words and gets what the models give for none.  Repeated rows and
    null doc_ids stay; an empty table gives no rows; other columns are ignored.
    """
    prepare(docs.sparkSession)
    rows, earlier = documents_of(docs).withColumn("__words", _words("text")).drop("text"), []
    for k, link in enumerate(chain.links):
        rows = link.probability(rows, earlier, f"__p{k}")
        earlier = [*earlier, f"__p{k}"]
    columns = [F.col("doc_id")]
    for k, link in enumerate(chain.links):
        columns += [F.col(f"__p{k}").alias(f"p_{link.category}"), (F.col(f"__p{k}") >= link.threshold).alias(f"is_{link.category}")]
    return rows.select(columns)
