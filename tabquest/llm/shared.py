"""What the text operators share: settings, working tables, tokenizer files, pieces of text."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabquest.session import configure, work_dir

# Rows and bytes of one Arrow batch: texts differ a thousandfold in length, so both are bounded.
ARROW_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16777216",
}
# A tokenizer file is broadcast; larger ones are refused.
MAX_FILE_BYTES = 64 * 1024 * 1024
# Distinct pieces whose ids a Python worker keeps; further ones are encoded each time they occur.
MAX_KEPT_PIECES = 500_000


_SHIPPED: set[str] = set()


def _ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that it need not be installed there.

    Spark's file server copies the archive from the driver; executors started later get it as well.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as packed:
        for source in sorted(package.rglob("*.py")):
            packed.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the text operators; partition counts stay as the cluster sets them."""
    configure(spark)
    _ship_package(spark)
    for key, value in ARROW_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents_of(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` and ``text``, a null text as the empty one; other columns stay unread."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def tokenizer_path(name: str) -> str:
    """Where the installed public tokenizers keep the file ``name``."""
    import public_tokenizers

    return public_tokenizers.path(name)


def broadcast_file(spark: SparkSession, path: str):
    """The bytes of a small local file, sent to every executor once."""
    if os.path.getsize(path) > MAX_FILE_BYTES:
        raise ValueError(f"{path} is too large to broadcast")
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


_KEPT: dict[str, object] = {}


def kept(key: str, make: Callable[[], object]):
    """An object that the tasks of one operator share in a worker; another operator's is dropped first."""
    if key not in _KEPT:
        release()
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """Drop what an earlier operator has kept in this worker and give its memory back to the system."""
    _KEPT.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # GNU's allocator keeps freed pages otherwise
    if trim:
        trim(0)


def loaded(key: str, content: bytes, load: Callable[[bytes], object]):
    """What ``load`` makes of a file, once for the tasks of an operator."""
    return kept(f"{key} {len(content)} {zlib.crc32(content)}", lambda: load(content))


def bounded(batch: pa.RecordBatch, column: str, most: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``most`` bytes, so that memory follows bytes, not rows."""
    if not batch.num_rows:
        return
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < batch.num_rows:
        base = sizes[first - 1] if first else 0
        last = max(int(np.searchsorted(sizes, base + most, side="right")), first + 1)
        yield batch.slice(first, last - first)
        first = last


class PieceIds:
    """Ids of distinct pieces of text, encoded once and kept in flat arrays.

    ``encode`` takes a list of pieces and gives all their ids in a row and how many
    each has.  At most ``limit`` pieces are kept; what is rarer is encoded again.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = MAX_KEPT_PIECES):
        self.encode, self.limit = encode, limit
        self.slots: dict[str, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.starts = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)

    def find(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, and where the ids of each piece start and how many there are."""
        get = self.slots.get
        slots = np.fromiter((get(p, -1) for p in pieces), np.int64, len(pieces))
        missing = np.flatnonzero(slots < 0)
        if not len(missing):
            return self.flat, self.starts[slots], self.counts[slots]
        new = [pieces[i] for i in missing]
        ids, counts = self.encode(new)
        kept = len(self.starts)
        slots[missing] = np.arange(kept, kept + len(new))
        flat = np.concatenate([self.flat, ids.astype(np.uint32)])
        starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
        counts = np.concatenate([self.counts, counts])
        room = min(self.limit - kept, len(new))
        if room > 0:
            self.slots.update(zip(new[:room], range(kept, kept + room)))
            self.starts, self.counts = starts[: kept + room], counts[: kept + room]
            self.flat = flat[: int(self.starts[-1] + self.counts[-1])]
        return flat, starts[slots], counts[slots]


def spans_of(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions of all spans (start, count), one after the other."""
    total = int(counts.sum())
    shift = starts - (np.cumsum(counts) - counts)
    return np.repeat(shift, counts) + np.arange(total)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space of every text in a row, and how many each text has."""
    lists = pc.ascii_split_whitespace(texts)
    values, offsets = lists.values, np.asarray(lists.offsets)
    full = pc.not_equal(pc.binary_length(values), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return values.filter(full), np.diff(before[offsets])
