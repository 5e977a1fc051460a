"""Token ids of a corpus in a compact file format, written in document order and read back.

Ids are replaced by their rank by frequency over the whole corpus, so that common ones are
small numbers.  A number takes one to four bytes, fewer for smaller ones; its length stands in
two bits of a separate stream of control bytes, four numbers to a byte.  Decoding looks up the
lengths of four numbers at once in a table of 256 rows and gathers the bytes with numpy.

Files are Parquet, so that any store Spark knows can hold them: ``blocks`` has rows of whole
documents with about 65,536 ids, ``ranks`` the id of each rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabquest.llm.encoders import word_encoder
from tabquest.llm.shared import bounded, broadcast_file, documents_of, prepare
from tabquest.session import work_dir

BLOCK_IDS = 65_536
BLOCK_SCHEMA = (
    "part int, block long, start long, n_ids long, doc_ids array<bigint>, counts array<bigint>, "
    "control binary, data binary"
)
READ_SCHEMA = "doc_id long, start long, n_tokens long, ids binary"

# Lengths of the four numbers that a control byte stands for, the first in its lowest bits.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def encode_numbers(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    values = values.astype("<u4")
    extra = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = extra
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    kept = np.arange(4) <= extra[:, None]
    return control.astype(np.uint8).tobytes(), values.view(np.uint8).reshape(-1, 4)[kept].tobytes()


def decode_numbers(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers of a control stream and its data."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    starts = np.cumsum(lengths) - lengths
    padded = np.frombuffer(data + b"\0\0\0", np.uint8)
    values = padded[starts].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(lengths > k)
        values[longer] |= padded[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


def _tokenised(docs: DataFrame, tokenizer_file: str, end_id: int) -> DataFrame:
    """doc_id, n, check and ids; ids take two bytes each where the vocabulary allows it."""
    content = broadcast_file(docs.sparkSession, tokenizer_file)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(content.value)
        for whole in batches:
            for batch in bounded(whole, "text"):
                ids, counts = encoder(batch.column("text"))
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id)
                counts, ends = counts + 1, ends + np.arange(1, len(ends) + 1)
                raw = ids.astype("<u2" if ids.max(initial=0) < 65_536 else "<u4")
                data = [raw[a:b].tobytes() for a, b in zip(ends - counts, ends)]
                checks = [zlib.crc32(d) for d in data]
                columns = [batch.column("doc_id"), pa.array(counts), pa.array(checks, pa.int64()), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "check", "ids"])

    return documents_of(docs).mapInArrow(encode, "doc_id long, n long, check long, ids binary")


def _numbers(ids: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4")


def _frequencies(tokenised: DataFrame) -> list[tuple[int, int]]:
    """(id, occurrences) over the corpus: at most one row for each entry of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids, n in zip(batch.column("ids").to_pylist(), batch.column("n").to_pylist()):
                found = np.bincount(_numbers(ids, n))
                if len(found) > len(total):
                    total = np.pad(total, (0, len(found) - len(total)))
                total[: len(found)] += found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    counted = tokenised.select("n", "ids").mapInArrow(count, "id long, n long")
    return [tuple(r) for r in counted.groupBy("id").agg(F.sum("n").alias("n")).collect()]


def write_token_files(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 2) -> None:
    """Write the ids of all documents, each with ``end_id`` behind it, to ``path``.

    Ascending by doc_id (null first); rows with equal doc_id by number of ids and check sum, so
    equal rows are interchangeable.  A null text counts as empty.  An empty table gives no blocks.
    """
    spark = prepare(docs.sparkSession)
    raw_path = work_dir(spark, "ids")
    tokenised = _tokenised(docs, tokenizer_file, end_id)
    tokenised.write.option("compression", "zstd").parquet(raw_path)
    raw = spark.read.schema(tokenised.schema).parquet(raw_path)
    ranked = sorted(_frequencies(raw), key=lambda x: (-x[1], x[0]))
    rank_of = np.zeros(max((i for i, _ in ranked), default=0) + 1, np.uint32)
    for rank, (number, _) in enumerate(ranked):
        rank_of[number] = rank
    ranks = spark.sparkContext.broadcast(rank_of)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        start = block = 0
        doc_ids, pending, held = [], [], 0

        def made() -> pa.RecordBatch:
            nonlocal start, block, held
            control, data = encode_numbers(ranks.value[np.concatenate(pending)])
            row = [part, block, start, held, list(doc_ids), [len(p) for p in pending], control, data]
            start, block, held = start + held, block + 1, 0
            doc_ids.clear()
            pending.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _BLOCK_TYPES)], _BLOCK_NAMES)

        for batch in batches:
            for doc_id, n, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "ids"))):
                doc_ids.append(doc_id)
                pending.append(_numbers(ids, n))
                held += n
                if held >= BLOCK_IDS:
                    yield made()
        if pending:
            yield made()

    order = ["doc_id", "n", "check"]
    ordered = raw.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.mapInArrow(code, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(f"{path}/blocks")
    spark.createDataFrame([(r, i, n) for r, (i, n) in enumerate(ranked)], "rank long, id long, n long").write.parquet(
        f"{path}/ranks"
    )


_BLOCK_NAMES = ["part", "block", "start", "n_ids", "doc_ids", "counts", "control", "data"]
_BLOCK_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files at ``path``: doc_id, start (ids before it), n_tokens, ids (4 bytes each).

    A text that was null or empty has the end id alone.  Repeated rows and null doc_ids come back as
    they were written; files of an empty table give no rows.
    """
    blocks = prepare(spark).read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    ranks = spark.read.schema("rank long, id long, n long").parquet(f"{path}/ranks").select("rank", "id").collect()
    id_of = np.zeros(len(ranks), "<u4")
    for rank, number in ranks:
        id_of[rank] = number
    ids = spark.sparkContext.broadcast(id_of)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row for each file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.array(row["counts"], np.int64)
                numbers = ids.value[decode_numbers(row["control"], row["data"], row["n_ids"])]
                ends = np.cumsum(counts)
                data = [numbers[a:b].tobytes() for a, b in zip(ends - counts, ends)]
                columns = [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(row["before"] + row["start"] + ends - counts),
                    pa.array(counts),
                    pa.array(data, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])

    return blocks.join(firsts, "part").mapInArrow(decode, READ_SCHEMA)
