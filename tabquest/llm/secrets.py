"""Secrets in texts: patterns, and a battery of randomness tests with control of false discoveries.

Only DataFrame functions.  Patterns give the base kinds.  Between assignments, runs of letters,
digits and the signs of base-64 codes are candidates; the smallest usual encoding whose alphabet
holds a run's characters, and of whose kinds of characters the run has each, is its encoding.  If a
run's characters were drawn at random from that alphabet,

* the pairs of equal characters (the chi-squared statistic, less its mean, counts these) would be about Poisson,
* the changes between the lower and the upper half of the alphabet, one less than its runs, would be binomial,
* neighbouring characters would not be correlated.

The three two-sided p-values, which depend on each other, are combined by the Cauchy method.  Words,
paths and counters have tiny ones, random runs evenly spread ones.  The runs that are not random are
found by the procedure of Benjamini and Hochberg over the distinct runs of all documents, separately for
each encoding and doubling of the length, since short runs can show less: of those found, at most
``FALSE_SHARE`` are expected to be random.  All other runs are reported as secrets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabquest.llm.shared import prepare, stored

BASE_KINDS = ("assign", "access", "hex")
RANDOM_KIND = "random"
# The patterns of the base kinds and the least number of characters.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"(AKIA[A-Z0-9]{14,})"
HEX = r"([0-9a-f]{16,})"
# Runs that are tested, and their least length.
RUN_LEAST = 20
RUN = rf"([A-Za-z0-9+/_-]{{{RUN_LEAST},}}={{0,2}})"
LOWER, UPPER_CASE, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
# Encodings by their alphabet in the order of its values, smallest first, and patterns of which a run must hold all.
ENCODINGS = {
    "hex": (DIGITS + "ABCDEF", ["[0-9]", "[A-F]"]),
    "base32": (UPPER_CASE + "234567", ["[2-7]", "[A-Z]"]),
    "base36": (DIGITS + LOWER, ["[0-9]", "[a-z]"]),
    "base36_upper": (DIGITS + UPPER_CASE, ["[0-9]", "[A-Z]"]),
    "base62": (DIGITS + UPPER_CASE + LOWER, ["[A-Z]", "[a-z]"]),
    "base64": (UPPER_CASE + LOWER + DIGITS + "+/", ["[+/]", "[A-Z]", "[a-z]"]),
    "base64url": (UPPER_CASE + LOWER + DIGITS + "-_", ["[-_]", "[A-Z]", "[a-z]"]),
}
# p-values are rounded up to powers of ten in quarters, down to ten to the minus ten.
STEPS_PER_TEN = 4
LAST_STEP = 40
# Of the runs found not to be random, the share that may be expected to be random.
FALSE_SHARE = 0.02
SPAN_TYPE = "array<struct<start:int,end:int,found:string>>"


# ---- places of matches ------------------------------------------------------------


def _prefix_sums(sizes: Column) -> Column:
    """Sums of the elements up to each, in as many rounds as the length has binary digits."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(sizes) + F.lit(1.0))).cast("int"))

    def add(sums: Column, k: Column) -> Column:
        step = F.pow(F.lit(2.0), k).cast("int")
        return F.transform(sums, lambda v, i: v + F.when(i >= step, F.get(sums, i - step)).otherwise(F.lit(0)))

    return F.aggregate(rounds, sizes, add)


def located(text: Column, pattern: str, offset: Column | None = None) -> Column:
    """All matches of a pattern as structs of start, end (exclusive, in code points) and found."""
    offset = F.lit(0) if offset is None else offset
    parts, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # The part behind the last match has no match with it and goes.
    gaps = F.zip_with(parts, matches, lambda part, m: F.length(part) + F.length(m))
    spans = F.zip_with(
        _prefix_sums(gaps),
        matches,
        lambda end, m: F.struct((offset + end - F.length(m)).alias("start"), (offset + end).alias("end"), m.alias("found")),
    )
    found = F.filter(spans, lambda s: s["found"].isNotNull())
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN_TYPE))


# ---- the tests ----------------------------------------------------------------------


def two_sided(z: Column) -> Column:
    """Two-sided p-value of a standard normal value, by a rational approximation of five terms; not below 1e-30."""
    size = F.least(F.abs(z), F.lit(12.0))
    t = F.lit(1.0) / (size * 0.2316419 + 1)
    poly = F.lit(0.0)
    for term in (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530):
        poly = (poly + term) * t
    return F.greatest(F.least(F.exp(-size * size / 2) * poly * 0.7978845608028654, F.lit(1.0)), F.lit(1e-30))


def encoding_of(run: Column) -> Column:
    """Name of the smallest encoding that a run (without padding) is written in; null if there is none."""
    chosen = F.lit(None).cast("string")
    for name, (alphabet, needed) in reversed(ENCODINGS.items()):
        fits = F.translate(run, alphabet, "") == ""
        for pattern in needed:
            fits = fits & run.rlike(pattern)
        chosen = F.when(fits, F.lit(name)).otherwise(chosen)
    return chosen


def equal_pairs(run: Column, alphabet: Column) -> Column:
    """Pairs of places of a run with the same character."""

    def add(total: Column, c: Column) -> Column:
        n = (F.length(run) - F.length(F.replace(run, c, F.lit("")))).cast("double")
        return total + n * (n - 1) / 2

    return F.aggregate(F.split(alphabet, ""), F.lit(0.0), add)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def battery(run: Column, alphabet: Column) -> list[Column]:
    """Standardised values of the three tests for a run of independent, evenly drawn characters of an alphabet."""
    n, k = F.length(run).cast("double"), F.length(alphabet).cast("double")
    pairs, expected = equal_pairs(run, alphabet), n * (n - 1) / 2 / k
    uniformity = (F.sqrt(pairs) + F.sqrt(pairs + 1) - F.sqrt(4 * expected + 1)) / F.sqrt(1 - 1 / k)
    values = F.transform(F.split(run, ""), lambda c: F.position(c, alphabet).cast("double"))
    before, after = F.slice(values, F.lit(1), F.length(run) - 1), F.slice(values, F.lit(2), F.length(run) - 1)
    changes = _sum(F.zip_with(before, after, lambda x, y: ((x > k / 2) != (y > k / 2)).cast("double")))
    excess = changes - (n - 1) / 2
    runs = F.signum(excess) * F.greatest(F.abs(excess) - 0.5, F.lit(0.0)) / F.sqrt((n - 1) / 4)
    mean, variance = (k + 1) / 2, (k * k - 1) / 12
    serial = _sum(F.zip_with(before, after, lambda x, y: (x - mean) * (y - mean))) / (variance * F.sqrt(n - 1))
    return [uniformity, runs, serial]


def combined(p_values: list[Column]) -> Column:
    """One p-value of several that may depend on each other, by the mean of Cauchy quantiles."""
    quantiles = [F.tan((0.5 - F.least(p, F.lit(0.99))) * 3.141592653589793) for p in p_values]
    total = quantiles[0]
    for q in quantiles[1:]:
        total = total + q
    return F.atan2(F.lit(1.0), total / len(quantiles)) / 3.141592653589793


def step_of(p: Column) -> Column:
    """p-values in steps: step j stands for ten to the minus j quarters, not below the p-value."""
    return F.least(F.greatest(F.floor(-F.log10(p) * STEPS_PER_TEN), F.lit(0)), F.lit(LAST_STEP)).cast("int")


def tested(runs: Column) -> Column:
    """Runs (structs of start, end, found) that have an encoding, with it, their class of length, step and a hash."""
    alphabets = F.create_map(*[F.lit(x) for name, (alphabet, _) in ENCODINGS.items() for x in (name, alphabet)])
    coded = F.transform(
        runs, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), F.rtrim(r["found"], F.lit("=")).alias("run"), encoding_of(F.rtrim(r["found"], F.lit("="))).alias("encoding"))
    )
    return F.transform(
        F.filter(coded, lambda r: r["encoding"].isNotNull()),
        lambda r: F.struct(
            r["start"].alias("start"),
            r["end"].alias("end"),
            r["encoding"].alias("encoding"),
            F.floor(F.log2(F.length(r["run"]))).cast("int").alias("doublings"),
            step_of(combined([two_sided(z) for z in battery(r["run"], F.element_at(alphabets, r["encoding"]))])).alias("step"),
            F.xxhash64(r["run"]).alias("key"),
        ),
    )


# ---- the corpus -----------------------------------------------------------------------


def _candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base spans of each kind, and tested runs outside of them."""
    text = F.coalesce("text", F.lit(""))
    assigned = docs.select("doc_id", text.alias("text"), located(text, ASSIGN).alias("assigned"), F.split(text, ASSIGN, -1).alias("parts"))
    starts = F.concat(F.array(F.lit(0)), F.col("assigned.end"))
    runs = F.flatten(F.zip_with("parts", starts, lambda p, start: located(p, RUN, start)))
    spans = assigned.select(
        "doc_id",
        F.filter("assigned", lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 2)) >= ASSIGN_LEAST).alias("assign"),
        located(F.col("text"), ACCESS).alias("access"),
        located(F.col("text"), HEX).alias("hex"),
        F.filter(runs, lambda r: ~r["found"].rlike(f"{ACCESS}|{HEX}")).alias("runs"),
    )
    return spans.select("doc_id", "assign", "access", "hex", tested(F.col("runs")).alias("runs"))


def limits(runs: DataFrame) -> DataFrame:
    """Per encoding and doubling of the length the least step (largest p-value) at which runs count as not random.

    ``runs`` has the distinct runs with encoding, doublings and step.  Null where no step will do.
    """
    groups = ["encoding", "doublings"]
    steps = runs.groupBy(*groups, "step").agg(F.count("*").alias("n"))
    listed = steps.groupBy(*groups).agg(F.collect_list(F.struct("step", "n")).alias("steps"))  # at most LAST_STEP + 1 each

    def count(least: Column) -> Column:
        return F.aggregate(F.filter("steps", lambda s: s["step"] >= least), F.lit(0).cast("long"), lambda total, s: total + s["n"])

    enough = F.filter(
        F.sequence(F.lit(0), F.lit(LAST_STEP)),
        lambda j: (count(j) > 0) & (F.pow(F.lit(10.0), -j / STEPS_PER_TEN) * count(F.lit(0)) <= FALSE_SHARE * count(j)),
    )
    return listed.select(*groups, F.array_min(enough).alias("limit"))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans`` of every row: structs of start, rank of the kind, end, kind and encoding, in order.

    Starts and ends (exclusive) are code points.  Base kinds are assign, access and hex; ``random`` are
    runs outside of these that are not told from random ones of their encoding.  A null or empty text has no
    spans; repeated rows and null doc_ids stay, a run counts once for the limits however often it occurs;
    an empty table gives no rows; other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    found = stored(_candidates(docs), "candidates")
    distinct = found.select(F.inline("runs")).select("encoding", "doublings", "step", "key").distinct()
    # At most one row per encoding and doubling of the length: a few hundred numbers.
    table = limits(distinct).where("limit IS NOT NULL").select(F.concat_ws(":", "encoding", "doublings").alias("name"), "limit")
    known = {r["name"]: r["limit"] for r in table.collect()}
    limit = F.create_map(*[F.lit(x) for pair in known.items() for x in pair]) if known else F.lit(None).cast("map<string,int>")
    kept = F.filter(
        "runs",
        lambda r: F.coalesce(r["step"] < F.try_element_at(limit, F.concat_ws(":", r["encoding"], r["doublings"])), F.lit(True)),
    )

    def as_spans(rows: Column, kind: str, encoding) -> Column:
        rank = [*BASE_KINDS, RANDOM_KIND].index(kind)
        return F.transform(
            rows,
            lambda r: F.struct(
                r["start"].alias("start"), F.lit(rank).alias("rank"), r["end"].alias("end"), F.lit(kind).alias("kind"), encoding(r).alias("encoding")
            ),
        )

    base = [as_spans(F.col(kind), kind, lambda r: F.lit(None).cast("string")) for kind in BASE_KINDS]
    return found.select("doc_id", F.array_sort(F.concat(*base, as_spans(kept, RANDOM_KIND, lambda r: r["encoding"]))).alias("spans"))


def count_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def span_text(spans: str, kinds: tuple[str, ...] | None = None) -> Column:
    """``kind:start:end`` of the spans of the given kinds (all), joined by commas."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else F.col(spans)
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
