"""SimHash near-duplicates by tiled exact comparison.

A fingerprint has 64 bits, each set if most hashes of the text's word shingles have it set.
Two fingerprints within ``radius`` bits are linked, and linked documents form a group.

Equal fingerprints are compared once, whatever the number of copies.  Fingerprints within
``radius`` bits agree in at least one of ``radius + 1`` blocks of bits, so only those that share a
block meet (a cell).  A cell is compared in tiles ordered by population count: numpy exclusive-or
and bit counts of one tile against another, and tile pairs whose population counts differ by more
than the radius are skipped.  A crowded cell is cut into many tiles and its tile pairs become
rows of many tasks.  A tile pair reports enough links to connect what it found connected, not
all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from tabquest.llm.components import components
from tabquest.llm.shared import bounded, documents_of, prepare, release, spans_of, stored, words_of

# Rows of a tile, and of the matrices that are compared at once.
TILE_ROWS = 4096
_SQUARE = 1024
# Cells up to this size are compared many at a time.
_SMALL_CELL = 64
# Rows that a comparing task holds before it works on them; a cell or tile pair is never cut.
_CHUNK_ROWS = 200_000
# Least hashes that make up a band, and bands of a text, for comparison by similarity.
BAND_HASHES = 4
BANDS = 20
# Bits in which fingerprints of texts with that similarity may differ: 9.7 are expected at 0.8.
SIMILAR_RADIUS = 26
# Bits of the parities of a set of shingles, and pairs whose parities are compared at once.
PARITY_BITS = 1024
_PARITY_PAIRS = 65_536


def shingle_hashes(texts: pa.Array, words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' word shingles in a row, and how many each text has."""
    values, counts = words_of(pc.ascii_lower(texts))
    ends = np.cumsum(counts)
    n_shingles = np.where(counts == 0, 0, np.maximum(counts - words + 1, 1))
    long = counts >= words
    starts = spans_of((ends - counts)[long], n_shingles[long])
    full = len(values) - words + 1
    joined = (
        pc.binary_join_element_wise(*[values.slice(k, full) for k in range(words)], " ").take(pa.array(starts)).to_pylist()
        if full > 0
        else []
    )
    hashes = np.empty(int(n_shingles.sum()), np.uint64)
    ends_out = np.cumsum(n_shingles)
    whole = np.repeat(long, n_shingles)
    digest = xxhash.xxh64_intdigest
    hashes[whole] = np.fromiter((digest(s, seed) for s in joined), np.uint64, len(joined))
    for i in np.flatnonzero(~long & (counts > 0)):  # fewer words than a shingle has: all of them
        text = " ".join(values.slice(int(ends[i] - counts[i]), int(counts[i])).to_pylist())
        hashes[ends_out[i] - 1] = digest(text, seed)
    return hashes, n_shingles


def fingerprints(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text the bits that more than half of its hashes have set; none: zero."""
    totals = np.zeros((len(counts), 64), np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    for first in range(0, len(hashes), 250_000):
        part = hashes[first : first + 250_000]
        whose = owner[first : first + 250_000]
        heads = np.flatnonzero(np.diff(whose, prepend=-1))
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        totals[whose[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
    return np.packbits(2 * totals > counts[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def _fingerprinted(rows: DataFrame, shingle_words: int, seed: int) -> DataFrame:
    """``rows`` with column ``fingerprint`` in place of ``text`` (not null)."""
    prepare(rows.sparkSession)
    others = [c for c in rows.columns if c != "text"]
    schema = StructType([rows.schema[c] for c in others]).add("fingerprint", "long")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for whole in batches:
            for batch in bounded(whole, "text", 6_000_000):
                prints = fingerprints(*shingle_hashes(batch.column("text"), shingle_words, seed))
                columns = [*(batch.column(c) for c in others), pa.array(prints.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, [*others, "fingerprint"])

    return rows.mapInArrow(compute, schema)


def with_fingerprints(docs: DataFrame, shingle_words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and ``fingerprint`` (64 bits as a signed long) of every row."""
    return _fingerprinted(documents_of(docs), shingle_words, seed)


# ---- comparison ---------------------------------------------------------------


def _spanning(n: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between ``n`` items that connect the same ones as the given links, at most one per item."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if np.array_equal(new, label):
            moved = np.flatnonzero(label != np.arange(n))
            return label[moved], moved
        label = new


def _near(rows: np.ndarray, others: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(np.bitwise_count(rows[:, None] ^ others[None, :]) <= radius)


def tile_links(rows: np.ndarray, others: np.ndarray | None, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between fingerprints of two tiles, or within one (``others`` None)."""
    rows = rows[np.argsort(np.bitwise_count(rows), kind="stable")]
    both = rows if others is None else others[np.argsort(np.bitwise_count(others), kind="stable")]
    for i in range(0, len(rows), _SQUARE):
        a = rows[i : i + _SQUARE]
        low, high = int(np.bitwise_count(a[0])), int(np.bitwise_count(a[-1]))
        for j in range(i if others is None else 0, len(both), _SQUARE):
            b = both[j : j + _SQUARE]
            if int(np.bitwise_count(b[0])) - high > radius or low - int(np.bitwise_count(b[-1])) > radius:
                continue
            left, right = _near(a, b, radius)
            same = a[left] == b[right]
            if not same.all():
                left, right = _spanning(len(a) + len(b), left, right + len(a))
                nodes = np.concatenate([a, b])
                keep = nodes[left] != nodes[right]
                yield nodes[left][keep], nodes[right][keep]


def small_cell_links(cells: np.ndarray, prints: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within many small cells; rows are ordered by cell."""
    rows = np.arange(len(cells))
    shift = 1
    while True:
        rows = rows[: np.searchsorted(rows, len(cells) - shift)]
        rows = rows[cells[rows] == cells[rows + shift]]
        if not len(rows):
            return
        near = rows[np.bitwise_count(prints[rows] ^ prints[rows + shift]) <= radius]
        if len(near):
            yield prints[near], prints[near + shift]
        shift += 1


def _group_links(keys: np.ndarray, prints: np.ndarray, second: np.ndarray, radius: int):
    """Links of whole groups: a group without rows of a second tile is compared with itself."""
    heads = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
    sizes = np.diff(heads, append=len(keys))
    small = np.repeat(sizes <= _SMALL_CELL, sizes) & ~np.repeat(np.logical_or.reduceat(second, heads), sizes)
    yield from small_cell_links(keys[small], prints[small], radius)
    for head, size in zip(heads, sizes):
        if not small[head]:
            part, side = prints[head : head + size], second[head : head + size]
            others = part[side] if side.any() else None
            if not side.all():
                yield from tile_links(part[~side], others, radius)


def _compare(radius: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            keys, prints, second = (np.concatenate(x) for x in zip(*held))
            cut = len(keys) if last else int(np.searchsorted(keys, keys[-1]))  # keys ascend; the last may go on
            held[:] = [(keys[cut:], prints[cut:], second[cut:])]
            if cut:
                for left, right in _group_links(keys[:cut], prints[:cut], second[:cut], radius):
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (left, right)], ["a", "b"])

        rows = 0
        for batch in batches:
            if batch.num_rows:
                held.append(
                    (
                        batch.column("task").to_numpy(),
                        batch.column("fingerprint").to_numpy().view(np.uint64),
                        batch.column("second").to_numpy(zero_copy_only=False),
                    )
                )
                rows += batch.num_rows
                if rows >= _CHUNK_ROWS:
                    yield from flush(False)
                    rows = len(held[0][0])
        if held and sum(len(h[0]) for h in held):
            yield from flush(True)

    return compare


def cells_of(prints: DataFrame, blocks: int) -> DataFrame:
    """Each fingerprint once for each of its blocks of bits: ``cell`` tells the block and its value."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    values: list[Column] = []
    for k, (low, high) in enumerate(zip(edges, edges[1:])):
        value = F.shiftrightunsigned("fingerprint", low).bitwiseAND(F.lit((1 << (high - low)) - 1))
        values.append(F.xxhash64(F.lit(k), value) if high - low > 48 else value + F.lit(k << 48))
    return prints.select("fingerprint", F.explode(F.array(*values)).alias("cell"))


def links_within(prints: DataFrame, radius: int, blocks: int | None = None, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links ``a``, ``b`` that connect all distinct fingerprints within ``radius`` bits.

    ``prints`` has distinct values in column ``fingerprint``.  With ``blocks`` above ``radius``
    (the default) no link is missed.
    """
    cells = cells_of(prints, blocks or radius + 1)
    per_count = cells.groupBy("cell", F.bit_count("fingerprint").alias("ones")).agg(F.count("*").alias("n"))
    crowded = (
        per_count.groupBy("cell")
        .agg(
            F.sum("n").alias("total"),
            F.map_from_entries(F.collect_list(F.struct("ones", F.ceil(F.col("n") / tile_rows).alias("tiles")))).alias("tiles"),
        )
        .where(F.col("total") > tile_rows)
        .select("cell", "tiles")
    )
    joined = cells.join(crowded, "cell", "left")
    ones = F.bit_count("fingerprint")
    mine = F.struct(ones.alias("ones"), F.pmod(F.hash("fingerprint"), F.element_at("tiles", ones)).cast("long").alias("tile"))
    reach = F.filter(
        F.sequence(ones - radius, ones + radius), lambda p: F.array_contains(F.map_keys("tiles"), p)
    )
    others = F.flatten(
        F.transform(
            reach,
            lambda p: F.transform(
                F.sequence(F.lit(0).cast("long"), F.element_at("tiles", p) - 1),
                lambda t: F.struct(p.alias("ones"), t.alias("tile")),
            ),
        )
    )
    tasks = F.transform(
        others,
        lambda o: F.struct(
            F.xxhash64("cell", F.least(mine, o), F.greatest(mine, o)).alias("task"), (mine > o).alias("second")
        ),
    )
    whole = F.array(F.struct(F.xxhash64("cell").alias("task"), F.lit(False).alias("second")))
    rows = joined.select("fingerprint", F.inline(F.when(F.col("tiles").isNull(), whole).otherwise(tasks)))
    dealt = rows.select("task", "second", "fingerprint").repartition("task").sortWithinPartitions("task")
    return dealt.mapInArrow(_compare(radius), "a long, b long")


def near_groups(prints: DataFrame, radius: int = 3) -> DataFrame:
    """``fingerprint`` and ``root``, one of its group, for fingerprints that are not their own root."""
    distinct = stored(prints.select("fingerprint").distinct(), "fingerprints")
    found = components(links_within(distinct, radius))
    return found.select(F.col("node").alias("fingerprint"), "root")


def with_components(docs: DataFrame, shingle_words: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (signed long) and component_id, the smallest doc_id of the group, per row.

    A null text has no words; texts without words have fingerprint zero and are linked like any
    other.  Repeated rows stay.  A null doc_id counts for a component_id only if its group has no
    other.  An empty table gives no rows; other columns are ignored.
    """
    prints = stored(with_fingerprints(docs, shingle_words, seed), "prints")
    groups = near_groups(prints, radius)
    smallest = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("smallest"))
    rooted = smallest.join(groups, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    ids = rooted.groupBy("root").agg(F.min("smallest").alias("component_id"))
    named = rooted.join(ids, "root").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text and the text (not null) of every row."""
    return docs.select(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("check"), F.coalesce("text", F.lit("")).alias("text"))


def _rows_with(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id and hash of the text are in ``keys``."""
    same = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & F.xxhash64("d.text").eqNullSafe(F.col("k.check"))
    return docs.alias("d").join(keys.hint("shuffle_hash").alias("k"), same, "left_semi")


def _first_of_each(docs: DataFrame, prints: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of ``docs``, one of each group of fingerprints; ``prints`` has doc_id, check and fingerprint of all."""
    rows = prints.groupBy("fingerprint", "doc_id", "check").agg(F.count("*").alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "check", "n")
    first = rows.groupBy("fingerprint").agg(F.min(order).alias("first"))
    rooted = first.join(groups, "fingerprint", "left").select(F.coalesce("root", "fingerprint").alias("root"), "first")
    kept = stored(rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.*"), "kept")
    single = _rows_with(docs, kept.where("n = 1"))
    repeated = kept.where("n > 1")
    if repeated.isEmpty():
        return single
    return single.unionByName(_rows_with(docs, repeated).dropDuplicates(["doc_id", "text"]))


def keep_one_of_each(docs: DataFrame, shingle_words: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """Rows of ``docs``, with all their columns, one of each group: the one with the smallest doc_id.

    A null doc_id comes last; equal ones go by a hash of the text.  Of rows with equal doc_id and
    text one stays.  Null texts and texts without words form a group.
    """
    prints = stored(_fingerprinted(_keyed(docs), shingle_words, seed), "prints")
    return _first_of_each(docs, prints, near_groups(prints, radius))


# ---- by similarity of the shingles --------------------------------------------


def _heads(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with hashes, and where the hashes of each start."""
    some = np.flatnonzero(counts)
    return some, (np.cumsum(counts) - counts)[some]


def band_keys(hashes: np.ndarray, counts: np.ndarray, seed: int) -> list[np.ndarray]:
    """For each of BANDS a key of the text's least hashes under BAND_HASHES orders (texts with hashes only)."""
    _, heads = _heads(counts)
    rng = np.random.default_rng(seed)
    keys = []
    for band in range(BANDS):
        key = np.full(len(heads), band + 1, np.uint64)
        for _ in range(BAND_HASHES):
            flip, factor = rng.integers(0, 1 << 64, 2, np.uint64)
            if len(heads):
                key = (key ^ np.minimum.reduceat((hashes ^ flip) * (factor | np.uint64(1)), heads)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
        keys.append(key)
    return keys


def parities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each set of hashes PARITY_BITS bits: whether an odd number of them falls to the bit.

    Each hash that only one of two sets has changes one bit, so two sets differ in at least as many
    hashes as in bits.
    """
    owner = np.repeat(np.arange(len(counts)), counts)
    places = (hashes >> np.uint64(40)).astype(np.int64) % PARITY_BITS
    odd = np.bincount(owner * PARITY_BITS + places, minlength=len(counts) * PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, PARITY_BITS), axis=1)


def _shingled(rows: DataFrame, words: int, seed: int, what: str) -> DataFrame:
    """``rows`` with ``fingerprint`` in place of ``text``, a hash of its words, and ``what``.

    ``what`` is "bands", or "shingles": the distinct ones, ``bits``, their SimHash fingerprint, and ``parity``.
    """
    prepare(rows.sparkSession)
    others = [c for c in rows.columns if c != "text"]
    schema = StructType([rows.schema[c] for c in others]).add("fingerprint", "long").add(what, ArrayType(LongType()))
    if what == "shingles":
        schema = schema.add("bits", "long").add("parity", "binary")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for whole in batches:
            for batch in bounded(whole, "text", 6_000_000):
                hashes, counts = shingle_hashes(batch.column("text"), words, seed)
                ends = np.cumsum(counts)
                whose = [hashes[e - n : e] for e, n in zip(ends, counts)]
                prints = np.fromiter((xxhash.xxh64_intdigest(h.tobytes(), seed) for h in whose), np.uint64, len(whose))
                if what == "bands":
                    sizes = np.where(counts > 0, BANDS, 0)
                    values = np.stack(band_keys(hashes, counts, seed), axis=1).ravel()
                else:
                    whose = [np.unique(h) for h in whose]
                    sizes = np.array([len(h) for h in whose])
                    values = np.concatenate(whose)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(values.view(np.int64)))
                columns = [*(batch.column(c) for c in others), pa.array(prints.view(np.int64)), lists]
                if what == "shingles":
                    columns.append(pa.array(fingerprints(values, sizes).view(np.int64)))
                    columns.append(pa.array([p.tobytes() for p in parities(values, sizes)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(compute, schema)


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` whose shingles have a Jaccard similarity of at least ``similarity``."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("fingerprint").alias(side), F.col("shingles").alias(f"{side}_set")), side)
    both = F.size(F.array_intersect("a_set", "b_set"))
    return pairs.where(both >= similarity * (F.size("a_set") + F.size("b_set") - both)).select("a", "b")


def rare_cells(sets: DataFrame, similarity: float) -> DataFrame:
    """Each text once for each ``cell``, a rare shingle by which similar texts find each other.

    Shingles are ordered by how many of the texts have them, rarest first, those of one text alone
    before all.  Two texts of ``size`` m and n of that similarity s have at least s / (1 + s) * (m + n) of
    them in common, so the first one that they share stands at a ``place`` with at least as many from
    there on in both; that is among the first (1 - s) * size + 1, and in the smaller text (``early``)
    among the first (1 - s) / (1 + s) * size + 1.
    """
    spread = sets.select("fingerprint", "bits", F.size("shingles").alias("size"), F.explode("shingles").alias("cell"))
    shared = spread.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    rare = F.array_sort(F.collect_list(F.struct("n", "cell")))
    texts = spread.join(shared, "cell").groupBy("fingerprint", "bits", "size").agg(rare.alias("rare"))
    own = F.col("size") - F.size("rare")

    def reach(share: float) -> Column:
        return F.col("size") - F.ceil(share * F.col("size") - 1e-6) + 1

    texts = texts.withColumns({"own": own, "reach": reach(similarity).cast("int")}).where("reach > own")
    placed = texts.select(
        "fingerprint", "bits", "size", "own", F.posexplode(F.slice("rare", F.lit(1), F.col("reach") - F.col("own"))).alias("at", "r")
    )
    place = F.col("own") + F.col("at")
    return placed.select(
        F.col("r.cell").alias("cell"), "fingerprint", "bits", "size", place.alias("place"),
        (place < reach(2 * similarity / (1 + similarity))).alias("early"),
    )


def _similar_rows(a: tuple, b: tuple, similarity: float) -> tuple:
    """Rows of ``a`` and of ``b``, side by side, that are of different groups and may be similar, by their sizes, places and parities."""
    (roots, sizes, places, odd), (other_roots, other_sizes, other_places, other_odd) = a[2:], b[2:]
    least = similarity / (1 + similarity) * (sizes + other_sizes) - 1e-6
    found = np.flatnonzero((roots != other_roots) & (np.minimum(sizes - places, other_sizes - other_places) >= least))
    most = (1 - similarity) / (1 + similarity) * (sizes + other_sizes) + 1e-6
    found = found[np.bitwise_count(odd[found] ^ other_odd[found]).sum(axis=1, dtype=np.int64) <= most[found]]
    return a[1][found], b[1][found], roots[found], other_roots[found]


def _taken(rows: tuple, which) -> tuple:
    return tuple(x[which] for x in rows)


def square_pairs(a: tuple, b: tuple | None, similarity: float, radius: int) -> Iterator[tuple]:
    """Pairs of a tile with another, or within one (``b`` None): fingerprints within ``radius`` bits that may be similar.

    A tile is bits, ids, roots, sizes, places and parities; so are the two sides of the pairs.
    """
    a = _taken(a, np.argsort(np.bitwise_count(a[0]), kind="stable"))
    both = a if b is None else _taken(b, np.argsort(np.bitwise_count(b[0]), kind="stable"))
    for i in range(0, len(a[0]), _SQUARE):
        x = _taken(a, slice(i, i + _SQUARE))
        low, high = int(np.bitwise_count(x[0][0])), int(np.bitwise_count(x[0][-1]))
        for j in range(i if b is None else 0, len(both[0]), _SQUARE):
            y = _taken(both, slice(j, j + _SQUARE))
            if int(np.bitwise_count(y[0][0])) - high > radius or low - int(np.bitwise_count(y[0][-1])) > radius:
                continue
            left, right = _near(x[0], y[0], radius)
            if b is None and i == j:
                left, right = left[left < right], right[left < right]
            for first in range(0, len(left), _PARITY_PAIRS):
                part = slice(first, first + _PARITY_PAIRS)
                yield _similar_rows(_taken(x, left[part]), _taken(y, right[part]), similarity)


def small_cell_pairs(cells: np.ndarray, rows: tuple, similarity: float, radius: int) -> Iterator[tuple]:
    """The same for many small cells at once; rows are ordered by cell."""
    at = np.arange(len(cells))
    shift = 1
    while True:
        at = at[: np.searchsorted(at, len(cells) - shift)]
        at = at[cells[at] == cells[at + shift]]
        if not len(at):
            return
        near = at[np.bitwise_count(rows[0][at] ^ rows[0][at + shift]) <= radius]
        yield _similar_rows(_taken(rows, near), _taken(rows, near + shift), similarity)
        shift += 1


def _cell_pairs(keys: np.ndarray, second: np.ndarray, rows: tuple, similarity: float, radius: int):
    """Pairs of whole cells and tile pairs."""
    heads = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
    sizes = np.diff(heads, append=len(keys))
    small = np.repeat(sizes <= _SMALL_CELL, sizes) & ~np.repeat(np.logical_or.reduceat(second, heads), sizes)
    yield from small_cell_pairs(keys[small], _taken(rows, small), similarity, radius)
    for head, size in zip(heads, sizes):
        side = second[head : head + size]
        if not small[head] and not side.all():
            part = _taken(rows, slice(head, head + size))
            yield from square_pairs(_taken(part, ~side), _taken(part, side) if side.any() else None, similarity, radius)


def _one_for_each(left: np.ndarray, right: np.ndarray, roots: np.ndarray, other_roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One of the pairs between any two groups."""
    ends = np.stack([np.minimum(roots, other_roots), np.maximum(roots, other_roots)], axis=1)
    first = np.unique(ends, axis=0, return_index=True)[1]
    return left[first], right[first]


def _compare_cells(similarity: float, radius: int, one_each: bool):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            keys = table["task"].to_numpy()
            cut = len(keys) if last else int(np.searchsorted(keys, keys[-1]))  # keys ascend; the last may go on
            held[:] = table.slice(cut).combine_chunks().to_batches()
            if cut:
                table = table.slice(0, cut)
                columns = [table[c].to_numpy() for c in ("bits", "fingerprint", "root", "size", "place")]
                odd = np.frombuffer(b"".join(table["parity"].to_pylist()), np.uint64).reshape(cut, -1)
                rows = (columns[0].view(np.uint64), *columns[1:], odd)
                for left, right, *roots in _cell_pairs(keys[:cut], table["second"].to_numpy(), rows, similarity, radius):
                    if len(left):
                        if one_each:
                            left, right = _one_for_each(left, right, *roots)
                        ends = (np.minimum(left, right), np.maximum(left, right))
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in ends], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(b.num_rows for b in held) >= _CHUNK_ROWS:
                    yield from flush(False)
        if held:
            yield from flush(True)

    return compare


def candidate_pairs(
    cells: DataFrame, sets: DataFrame, similarity: float, one_each: bool = False,
    radius: int = SIMILAR_RADIUS, tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Pairs ``a``, ``b`` of a cell that are in different groups (``root``) and may be similar.

    Cells without an ``early`` text or with texts of one group alone need no comparison.  Fingerprints
    within ``radius`` bits are found by tiles; a crowded cell is dealt out as pairs of tiles.  With
    ``one_each`` a comparison of tiles reports one pair between any two groups.
    """
    per = cells.groupBy("cell").agg(
        F.ceil(F.count("*") / tile_rows).alias("tiles"), F.min("root").alias("low"), F.max("root").alias("high"), F.max("early").alias("any")
    )
    rows = cells.join(per.where("low < high AND any").select("cell", "tiles"), "cell")
    rows = rows.join(sets.select("fingerprint", "parity"), "fingerprint")
    mine = F.pmod(F.hash("fingerprint").cast("long"), "tiles")
    tasks = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1),
        lambda o: F.struct(F.xxhash64("cell", F.least(mine, o), F.greatest(mine, o)).alias("task"), (mine > o).alias("second")),
    )
    dealt = rows.select("fingerprint", "bits", "root", "size", "place", "parity", F.inline(tasks))
    dealt = dealt.repartition("task").sortWithinPartitions("task")
    return dealt.mapInArrow(_compare_cells(similarity, radius, one_each), "a long, b long").distinct()


def similar_groups(docs: DataFrame, prints: DataFrame, words: int, similarity: float, seed: int) -> DataFrame:
    """``fingerprint`` and ``root``, one of its group, for fingerprints that are not their own root.

    Texts that share a band with another are compared, first with one of the band, which puts families
    of near copies together in about as many comparisons as they have texts; then, across the groups so
    far, those that share a rare shingle (``rare_cells``) and whose SimHash fingerprints are within
    SIMILAR_RADIUS bits: one pair between any two groups, which joins most groups that belong together,
    then all that are left.  What is found is confirmed by all shingles.
    """
    distinct = prints.groupBy("fingerprint").agg(F.first("bands").alias("bands"))
    members = distinct.select("fingerprint", F.explode("bands").alias("band"))
    firsts = members.groupBy("band").agg(F.min("fingerprint").alias("a"), F.max("fingerprint").alias("z")).where("a < z").drop("z")
    members = stored(members.join(firsts, "band").select("a", F.col("fingerprint").alias("b")).distinct(), "members")
    wanted = members.select(F.col("b").alias("fingerprint")).distinct()
    keys = prints.groupBy("fingerprint").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "check")).alias("key"))
    texts = _rows_with(docs, stored(keys.join(wanted, "fingerprint", "left_semi").select("key.*"), "keys"))
    sets = _shingled(_keyed(texts), words, seed, "shingles").select("fingerprint", "shingles", "bits", "parity")
    sets = stored(sets.dropDuplicates(["fingerprint"]), "sets")
    links = stored(_confirmed(members.where("a <> b"), sets, similarity), "first-links")
    cells = stored(rare_cells(sets, similarity), "cells")
    for one_each in (True, False):
        roots = stored(components(links).select(F.col("node").alias("fingerprint"), "root"), "roots")
        placed = cells.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
        pairs = stored(candidate_pairs(placed, sets, similarity, one_each), "pairs")
        links = stored(links.unionByName(_confirmed(pairs, sets, similarity)), "further-links")
    return components(links).select(F.col("node").alias("fingerprint"), "root")


def keep_one_of_similar(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """Rows of ``docs``, one of each group of texts whose sets of word shingles have that Jaccard similarity.

    Which row stays and how nulls and repeats count is as in ``keep_one_of_each``.  Similarity is
    exact; two texts of similarity s are compared unless all bands differ, which happens with
    probability (1 - s ** BAND_HASHES) ** BANDS: 0.00003 at 0.8, or their fingerprints differ in more
    than SIMILAR_RADIUS bits (README).
    """
    prints = stored(_shingled(_keyed(docs), shingle_words, seed, "bands"), "prints")
    return _first_of_each(docs, prints.drop("bands"), similar_groups(docs, prints, shingle_words, similarity, seed))
