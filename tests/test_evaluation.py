"""Evaluation metrics and their intervals against plain Python."""

import hashlib
import math
import random

import pytest

from tabquest.operators.evaluation import POISSON_STEPS, evaluate, poisson_weight

SCHEMA = "key string, expected_dataset string, ranked array<string>, expected_mode string, query_mode string, is_valid boolean, executed boolean, elapsed_ms double"


def weight(key, sample):
    u = int(hashlib.md5(f"{key}:{sample}".encode()).hexdigest()[:8], 16) / 2**32
    return sum(u >= sum(math.exp(-1) / math.factorial(i) for i in range(w + 1)) for w in range(12))


def plain_hits(row):
    key, expected, ranked, mode, found, valid, executed, ms = row
    ranked = ranked or []
    return {
        "selection_accuracy": None if expected is None else float(ranked[:1] == [expected]),
        "top2_recall": None if expected is None else float(expected in ranked[:2]),
        "mode_accuracy": None if mode is None else float(found == mode),
        "validity_rate": float(bool(valid)),
        "success_rate": float(bool(executed)) if valid else None,
        "response_ms": ms,
    }


def rows():
    rng = random.Random(1)
    maybe = lambda v: rng.choice([v, v, v, None])
    found = []
    for i in range(200):
        ranked = maybe(rng.sample(["a", "b", "c"], rng.randint(0, 3)))
        found.append((f"k{i}", maybe(rng.choice("abc")), ranked, maybe("full"), maybe(rng.choice(["full", "top"])), maybe(rng.random() < 0.8), maybe(rng.random() < 0.9), maybe(rng.random() * 100)))
    return found


def test_metrics_and_intervals(spark):
    given = rows()
    found = {r["metric"]: r for r in evaluate(spark.createDataFrame(given, SCHEMA).repartition(5), samples=40, level=0.9).collect()}
    for metric in plain_hits(given[0]):
        hits = [(r[0], plain_hits(r)[metric]) for r in given if plain_hits(r)[metric] is not None]
        assert found[metric]["n"] == len(hits)
        assert found[metric]["estimate"] == pytest.approx(sum(h for _, h in hits) / len(hits))
        means = []
        for sample in range(1, 41):
            drawn = [(weight(k, sample), h) for k, h in hits]
            means.append(sum(w * h for w, h in drawn) / sum(w for w, _ in drawn))
        means.sort()
        assert (found[metric]["low"], found[metric]["high"]) == (pytest.approx(means[2]), pytest.approx(means[37]))


def test_no_runs_and_runs_without_anything(spark):
    assert evaluate(spark.createDataFrame([], SCHEMA)).count() == 0
    found = {r["metric"]: r for r in evaluate(spark.createDataFrame([("k",) + (None,) * 7], SCHEMA), samples=20).collect()}
    assert found["selection_accuracy"]["n"] == 0 and found["selection_accuracy"]["estimate"] is None
    assert found["validity_rate"]["n"] == 1 and found["validity_rate"]["estimate"] == 0


def test_weights_at_the_borders_of_steps(spark):
    draws = sorted({0, 2**32 - 1} | {min(max(math.ceil(s * 2**32) + d, 0), 2**32 - 1) for s in POISSON_STEPS for d in (-1, 0, 1)})
    rows = spark.createDataFrame([(f"{u:08x}", sum(u / 2**32 >= s for s in POISSON_STEPS)) for u in draws], "digits string, expected int")
    found = rows.select("digits", "expected", poisson_weight(rows["digits"]).alias("w"))
    assert {r["digits"]: r["w"] for r in found.collect()} == {r["digits"]: r["expected"] for r in found.collect()}


def test_runs_are_read_once_drawn_once_and_by_all_cores(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).coalesce(1).write.parquet(str(tmp_path / "runs"))
    found = evaluate(spark.read.parquet(str(tmp_path / "runs")), samples=20)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1 and plan.count("Relation [") == 1
    assert f"Repartition {spark.sparkContext.defaultParallelism}, true" in plan
