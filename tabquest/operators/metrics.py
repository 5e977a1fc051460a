"""Metrics of answered questions: building records and summarising them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabquest import fixed_values as fv
from tabquest.operators.lookups import candidate_at

def rounded(value: Column) -> Column:
    return F.round(value.cast("double"), 3)


def build_records(runs: DataFrame, recorded_at: Column | None = None) -> DataFrame:
    """Metrics record of every run.

    Columns of ``runs``: ``question``, ``status``, ``error_message``, the struct
    ``context`` (suggested_candidate_index, suggested_dataset_name, candidates
    with candidate_index and query_mode), the struct ``generated``
    (chosen_candidate_index, chosen_dataset_name, final_mode, mode_decision),
    the struct ``validation`` (is_valid, violations), the struct ``execution``
    (row_count_returned) and the struct ``timings_ms``.  Each struct may be null.
    """
    when = recorded_at if recorded_at is not None else F.current_timestamp()
    candidates = F.col("context.candidates")
    suggested, chosen = F.col("context.suggested_candidate_index"), F.col("generated.chosen_candidate_index")
    chosen_mode = candidate_at(candidates, chosen)["query_mode"]
    final_mode = F.col("generated.final_mode")
    candidate_changed = F.coalesce(suggested != chosen, F.lit(False))
    mode_changed = F.coalesce(
        (chosen_mode != "") & (final_mode != "") & (chosen_mode != final_mode), F.lit(False)
    )
    return runs.select(
        F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx").alias("recorded_at"),
        "question",
        "status",
        "error_message",
        F.struct(*[rounded(F.col(f"timings_ms.{s}")).alias(s) for s in fv.TIMING_STAGES]).alias("timings_ms"),
        F.struct(
            F.coalesce(F.size(candidates), F.lit(0)).cast("long").alias("retrieved_candidate_count"),
            suggested.cast("long").alias("suggested_candidate_index"),
            chosen.cast("long").alias("chosen_candidate_index"),
            candidate_changed.alias("candidate_changed_by_model"),
            F.col("context.suggested_dataset_name").alias("suggested_dataset_name"),
            F.col("generated.chosen_dataset_name").alias("chosen_dataset_name"),
        ).alias("retrieval"),
        F.struct(
            chosen_mode.alias("suggested_mode_for_chosen_candidate"),
            final_mode.alias("final_mode"),
            mode_changed.alias("mode_changed_by_model"),
            F.col("generated.mode_decision").alias("mode_decision"),
        ).alias("query_mode"),
        F.struct((candidate_changed | mode_changed).alias("changed_candidate_or_mode")).alias("openai_decision"),
        F.struct(
            F.col("validation.is_valid").alias("is_valid"),
            F.coalesce(F.size("validation.violations"), F.lit(0)).cast("long").alias("violation_count"),
        ).alias("validation"),
        F.struct(
            F.col("execution").isNotNull().alias("executed"),
            F.coalesce("execution.row_count_returned", F.lit(0)).cast("long").alias("row_count_returned"),
        ).alias("execution"),
    )


def flat_records(records: DataFrame) -> DataFrame:
    """Typed records as the flat columns the summaries read."""
    return records.select(
        "status",
        F.col("retrieval.candidate_changed_by_model").alias("candidate_changed"),
        F.col("query_mode.mode_changed_by_model").alias("mode_changed"),
        F.col("openai_decision.changed_candidate_or_mode").alias("any_model_change"),
        F.col("validation.is_valid").alias("validation_success"),
        F.col("execution.executed").alias("execution_success"),
        F.col("query_mode.suggested_mode_for_chosen_candidate").alias("suggested_mode"),
        F.col("query_mode.final_mode").alias("final_mode"),
        *[F.col(f"timings_ms.{s}").alias(f"ms_{s}") for s in fv.TIMING_STAGES],
    )


COUNTED = ("validation_success", "execution_success", "candidate_changed", "mode_changed", "any_model_change")


def totals(flat: DataFrame) -> DataFrame:
    """One row: number of records, and per flag the count of true and its rate in percent."""
    sums = flat.agg(
        F.count("*").alias("total_queries"), *[F.count_if(F.col(c)).alias(f"{c}_count") for c in COUNTED]
    )
    total = F.nullif(F.col("total_queries"), F.lit(0))
    rates = [F.round(100.0 * F.col(f"{c}_count") / total, 3).alias(f"{c}_rate") for c in COUNTED]
    return sums.select("*", *rates)


def status_counts(flat: DataFrame) -> DataFrame:
    return flat.groupBy("status").agg(F.count("*").alias("query_count"))


def stage_averages(flat: DataFrame) -> DataFrame:
    """Average milliseconds per stage over the records that have one; null if none has."""
    wide = flat.agg(*[rounded(F.avg(f"ms_{s}")).alias(s) for s in fv.TIMING_STAGES])
    pairs = [F.struct(F.lit(s).alias("stage"), F.col(s).alias("average_ms")) for s in fv.TIMING_STAGES]
    return wide.select(F.explode(F.array(*pairs)).alias("p")).select("p.stage", "p.average_ms")


def mode_counts(flat: DataFrame) -> DataFrame:
    """Counts of suggested modes, final modes and transitions, one row per kind and value.

    The records are first reduced to one row per pair of modes.
    """
    pairs = flat.groupBy("suggested_mode", "final_mode").agg(F.count("*").alias("n"))
    suggested = F.nullif(F.col("suggested_mode"), F.lit(""))
    final = F.nullif(F.col("final_mode"), F.lit(""))
    labels = F.array(
        F.struct(F.lit("suggested").alias("kind"), suggested.alias("mode")),
        F.struct(F.lit("final").alias("kind"), final.alias("mode")),
        F.struct(F.lit("transition").alias("kind"), F.concat(suggested, F.lit(" -> "), final).alias("mode")),
    )
    return (
        pairs.select("n", F.explode(labels).alias("p"))
        .filter(F.col("p.mode").isNotNull())
        .groupBy("p.kind", "p.mode")
        .agg(F.sum("n").alias("query_count"))
    )


def summary_rows(flat: DataFrame) -> DataFrame:
    """The whole summary in long form ``(section, name, value)``, from one pass over the records.

    The records are reduced once to a row per status, pair of modes and flags,
    with sums and counts per stage; everything else is computed from that.
    """
    return summary_from_groups(group_records(flat))


_GROUP_KEYS = ("status", "suggested_mode", "final_mode")


def group_records(flat: DataFrame) -> DataFrame:
    """Additive partial results per status and pair of modes; batch and stream share them."""
    return flat.groupBy(*_GROUP_KEYS).agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col(c)).alias(f"n_{c}") for c in COUNTED],
        *[F.sum(f"ms_{s}").alias(f"sum_{s}") for s in fv.TIMING_STAGES],
        *[F.count(f"ms_{s}").alias(f"cnt_{s}") for s in fv.TIMING_STAGES],
    )


def summary_from_groups(groups: DataFrame) -> DataFrame:
    """The summary from partial results, which are read once.

    Every group becomes a few additive entries ``(section, name, value, weight)``;
    rates and averages are the quotient of their sums.
    """

    def entry(section: str, name, value: Column, weight: Column | None = None) -> Column:
        return F.struct(
            F.lit(section).alias("section"),
            (name if isinstance(name, Column) else F.lit(name)).alias("name"),
            value.cast("double").alias("value"),
            (weight if weight is not None else F.lit(None)).cast("double").alias("weight"),
        )

    n = F.col("n")
    suggested = F.nullif(F.col("suggested_mode"), F.lit(""))
    final = F.nullif(F.col("final_mode"), F.lit(""))
    entries = [entry("total", "total_queries", n)]
    for flag in COUNTED:
        entries.append(entry("count", flag, F.col(f"n_{flag}")))
        entries.append(entry("rate", flag, 100.0 * F.col(f"n_{flag}"), n))
    for stage in fv.TIMING_STAGES:
        entries.append(entry("average_ms", stage, F.coalesce(f"sum_{stage}", F.lit(0.0)), F.col(f"cnt_{stage}")))
    labels = [
        entry("status", F.col("status"), F.when(n > 0, n)),
        entry("suggested_mode", suggested, F.when(suggested.isNotNull(), n)),
        entry("final_mode", final, F.when(final.isNotNull(), n)),
        entry(
            "transition",
            F.concat(suggested, F.lit(" -> "), final),
            F.when(suggested.isNotNull() & final.isNotNull(), n),
        ),
    ]
    # A group of zeros, so that an empty log has a summary too.
    zero = groups.sparkSession.range(0, 1, 1, 1).select(
        *[F.lit(None if c in _GROUP_KEYS else 0).cast(groups.schema[c].dataType).alias(c) for c in groups.columns]
    )
    summed = (
        groups.unionByName(zero)
        .select(F.explode(F.array(*entries, *labels)).alias("e"))
        .select("e.*")
        .filter(F.col("value").isNotNull())
        .groupBy("section", "name")
        .agg(F.sum("value").alias("value"), F.sum("weight").alias("weight"))
    )
    is_quotient = F.col("section").isin("rate", "average_ms")
    quotient = F.round(F.col("value") / F.nullif(F.col("weight"), F.lit(0.0)), 3)
    return summed.select("section", "name", F.when(is_quotient, quotient).otherwise(F.col("value")).alias("value"))
