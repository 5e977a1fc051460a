"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Documents longer than the capacity are cut from their end, so that only their first piece
may be shorter.  Which sequence a piece goes to depends on lengths alone, so packing is
planned on the histogram of lengths (at most ``capacity`` rows, whatever the corpus):

* pieces above a third of the capacity meet at most two to a sequence: from the longest down,
  each takes the longest other one that still fits;
* smaller ones, from the longest down, go to the sequence with the smallest gap that holds them.

The plan is a list of runs ("ranks a to b of length l go to sequences from s, k to each, from
offset o"), and every piece finds its run by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabquest.llm.encoders import byte_encoder
from tabquest.llm.shared import bounded, broadcast_file, documents_of, prepare, stored
from tabquest.session import small_table

# Bytes of text that a task encodes at once, and distinct pieces whose ids a worker keeps.
SLICE_BYTES = 1_000_000
KEPT_PIECES = 100_000
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids binary, ids_crc32 long, part int, place long"
PLAN_SCHEMA = "length long, first_rank long, last_rank long, first_sequence long, per_sequence long, first_offset long"


def cut_lengths(n_tokens: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: whole ones behind a first one that may be shorter."""
    whole, rest = divmod(n_tokens, capacity)
    return [rest] * (rest > 0) + [capacity] * whole


def tokenised_pieces(docs: DataFrame, tokenizer_file: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of every document with their ids (little-endian, 4 bytes each)."""
    spark = prepare(docs.sparkSession)
    content = broadcast_file(spark, tokenizer_file)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(content.value, KEPT_PIECES)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)  # pieces of each length so far in this task
        for whole in batches:
            for batch in bounded(whole, "text", SLICE_BYTES):
                ids, counts = encoder(batch.column("text"))
                ends = np.cumsum(counts)
                raw = ids.astype("<u4", copy=False)
                end = np.array([end_id], "<u4").tobytes()
                rows = []
                for doc_id, first, n in zip(batch.column("doc_id").to_pylist(), ends - counts, counts):
                    data = raw[first : first + n].tobytes() + end
                    start = 0
                    for piece, length in enumerate(cut_lengths(int(n) + 1, capacity)):
                        own = data[4 * start : 4 * (start + length)]
                        rows.append((doc_id, piece, start, length, own, zlib.crc32(own), part, int(seen[length])))
                        seen[length] += 1
                        start += length
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PIECE_TYPES)], _PIECE_NAMES)

    return documents_of(docs).mapInArrow(cut, PIECE_SCHEMA)


_PIECE_NAMES = ["doc_id", "piece", "start", "length", "ids", "ids_crc32", "part", "place"]
_PIECE_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64()]


def plan_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, last rank, first sequence, pieces per sequence, first offset)."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    used = np.zeros(capacity + 1, np.int64)
    runs: list[tuple] = []
    gaps: dict[int, list[list[int]]] = {}  # gap -> [first sequence, how many]
    sequences = 0

    def put(length: int, n: int, sequence: int, per_sequence: int, offset: int) -> None:
        runs.append((length, int(used[length]), int(used[length] + n - 1), sequence, per_sequence, offset))
        used[length] += n
        left[length] -= n

    def opened(gap: int, n: int) -> int:
        nonlocal sequences
        first, sequences = sequences, sequences + n
        if gap:
            gaps.setdefault(gap, []).append([first, n])
        return first

    smallest_large = capacity // 3 + 1
    for length in range(capacity, smallest_large - 1, -1):
        while left[length]:
            top = min(capacity - length, length)
            fitting = np.flatnonzero(left[smallest_large : top + 1]) + smallest_large if top >= smallest_large else []
            other = int(fitting[-1]) if len(fitting) else 0
            if other == length and left[length] == 1:
                other = int(fitting[-2]) if len(fitting) > 1 else 0
            if not other:
                n = int(left[length])
                put(length, n, opened(capacity - length, n), 1, 0)
            elif other == length:
                n = int(left[length]) // 2
                put(length, 2 * n, opened(capacity - 2 * length, n), 2, 0)
            else:
                n = int(min(left[length], left[other]))
                first = opened(capacity - length - other, n)
                put(length, n, first, 1, 0)
                put(other, n, first, 1, length)
    for length in range(smallest_large - 1, 0, -1):
        while left[length]:
            fitting = [g for g in gaps if g >= length]
            gap = min(fitting) if fitting else capacity
            per_sequence = gap // length
            if not fitting:
                opened(capacity, max(1, int(left[length]) // per_sequence))
            group = gaps[gap][-1]
            n = min(group[1], int(left[length]) // per_sequence)
            if n == 0:  # the rest of this length fills a part of one sequence
                n, per_sequence = 1, int(left[length])
            first = group[0]
            group[0], group[1] = group[0] + n, group[1] - n
            if not group[1]:
                gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
            put(length, n * per_sequence, first, per_sequence, capacity - gap)
            rest = gap - per_sequence * length
            if rest:
                gaps.setdefault(rest, []).append([first, n])
    return runs


def pack(docs: DataFrame, tokenizer_file: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids, ids_crc32 (their
    check sum, so that it can be had without reading them), sequence_id, offset.

    A null text counts as empty and gives the end id alone; repeated rows are packed as often
    as they occur; a null doc_id is kept; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = stored(tokenised_pieces(docs, tokenizer_file, end_id, capacity), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = runs_table(spark, plan_runs(histogram, capacity))
    ranked = pieces.join(firsts, ["part", "length"]).withColumn("rank", F.col("before") + F.col("place"))
    within = F.col("rank").between(F.col("first_rank"), F.col("last_rank"))
    step = F.col("rank") - F.col("first_rank")
    return (
        ranked.alias("r")
        .join(F.broadcast(plan).alias("p"), (F.col("r.length") == F.col("p.length")) & within)
        .select(
            "doc_id",
            "piece",
            "start",
            "r.length",
            "ids",
            "ids_crc32",
            (F.col("first_sequence") + F.floor(step / F.col("per_sequence"))).alias("sequence_id"),
            (F.col("first_offset") + step % F.col("per_sequence") * F.col("r.length")).alias("offset"),
        )
    )


def runs_table(spark: SparkSession, runs: list[tuple]) -> DataFrame:
    """The plan as a table; its size depends on the capacity, not on the corpus."""
    return small_table(spark, runs, PLAN_SCHEMA)
