"""Evaluation of runs against expected answers, with bootstrap intervals from one pass.

A bootstrap sample gives every run a Poisson weight of mean one.  Weights are drawn from a hash of the
run's key and the sample's number, so they are the same wherever the run is processed, and weighted sums
add up: all samples and the estimates come from one aggregation with map-side combining.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabquest.session import spread

SAMPLES = 100
LEVEL = 0.95
# A weight of w or more has a probability of the Poisson distribution of mean one; weights beyond the last are never drawn.
POISSON_STEPS = tuple(sum(math.exp(-1) / math.factorial(i) for i in range(w + 1)) for w in range(12))


def drawn_digits(key: Column, sample: Column) -> Column:
    """The first eight hexadecimal digits of ``md5(key:sample)``: a uniform draw of 32 bits."""
    return F.substring(F.md5(F.concat_ws(":", key.cast("string"), sample.cast("string"))), 1, 8)


def poisson_weight(digits: Column) -> Column:
    """A Poisson weight of mean one: how many steps the draw reaches.

    Digits of one length sort like the numbers they stand for, so a step is compared as text, and the
    first one that is not reached ends the search.  Pass a column: an expression would be worked out per step.
    """
    reached = [math.ceil(step * 2**32) for step in POISSON_STEPS]  # exact: a power of two only moves the point
    weight = F
    for w, least in enumerate(r for r in reached if r < 2**32):
        weight = weight.when(digits < f"{least:08x}", w)
    return weight.otherwise(sum(r < 2**32 for r in reached))


def run_hits(runs: DataFrame) -> DataFrame:
    """``key`` and one column per metric: whether a run is right, null where the run says nothing about it.

    ``runs`` has key, expected_dataset, ranked (datasets, best first), expected_mode, query_mode, is_valid,
    executed and elapsed_ms.  A run without datasets, mode or verdict is wrong; one without an expected value does not count.
    """

    def hit(expected: Column, right: Column) -> Column:
        return F.when(expected.isNotNull(), F.coalesce(right, F.lit(False)).cast("double"))

    expected = F.col("expected_dataset")
    valid = F.coalesce("is_valid", F.lit(False))
    return runs.select(
        "key",
        hit(expected, F.get("ranked", F.lit(0)) == expected).alias("selection_accuracy"),
        hit(expected, F.array_contains(F.slice("ranked", 1, 2), expected)).alias("top2_recall"),
        hit(F.col("expected_mode"), F.col("query_mode") == F.col("expected_mode")).alias("mode_accuracy"),
        valid.cast("double").alias("validity_rate"),
        F.when(valid, F.coalesce("executed", F.lit(False)).cast("double")).alias("success_rate"),
        F.col("elapsed_ms").cast("double").alias("response_ms"),
    )


def evaluate(runs: DataFrame, samples: int = SAMPLES, level: float = LEVEL) -> DataFrame:
    """metric, n, estimate, low and high: the mean over the runs that count, and the percentile interval of its bootstrap samples.

    A metric that no run counts for has n 0 and nulls.  Limits are order statistics of the samples
    that have any weight: the first and the last within ``level``.
    """
    hits = run_hits(runs)
    metrics = [c for c in hits.columns if c != "key"]
    every = F.explode(F.sequence(F.lit(0), F.lit(samples)))  # sample 0 weighs each run once
    drawn = spread(hits).select("*", every.alias("sample")).withColumn("digits", drawn_digits(F.col("key"), F.col("sample")))
    weighted = drawn.withColumn("w", F.when(F.col("sample") == 0, 1).otherwise(poisson_weight(F.col("digits"))))
    sums = []
    for m in metrics:
        sums += [F.sum(F.col("w") * F.col(m)).alias(f"{m}_sum"), F.sum(F.when(F.col(m).isNotNull(), F.col("w"))).alias(f"{m}_n")]
    per_sample = weighted.groupBy("sample").agg(*sums)
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_sum").alias("total"), F.coalesce(f"{m}_n", F.lit(0)).cast("long").alias("n")) for m in metrics])
    # One row per sample and metric from here on.
    means = per_sample.select("sample", F.inline(rows)).withColumn("mean", F.when(F.col("n") > 0, F.col("total") / F.col("n")))
    # Both the estimate and the limits come from these rows, so that runs are read and drawn once.
    drawn_means = F.sort_array(F.collect_list(F.when(F.col("sample") > 0, F.col("mean"))))
    of_sample_0 = lambda c: F.max(F.when(F.col("sample") == 0, F.col(c)))
    found = means.groupBy("metric").agg(of_sample_0("n").alias("n"), of_sample_0("mean").alias("estimate"), drawn_means.alias("drawn"))
    outside = F.floor(F.size("drawn") * ((1 - level) / 2) + 1e-9).cast("int")
    return found.select(
        "metric", "n", "estimate", F.get("drawn", outside).alias("low"), F.get("drawn", F.size("drawn") - 1 - outside).alias("high")
    )
