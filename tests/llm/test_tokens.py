"""Ids, token files and packing against the library, one document at a time."""

import os
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given as for_all
from hypothesis import settings
from hypothesis import strategies as st

from llm_helpers import rows_of

from tabquest.llm import packing, token_files
from tabquest.llm.encoders import ByteEncoder, WordEncoder, load_tokenizer
from tabquest.llm.shared import tokenizer_path
from tabquest.session import work_dir


@pytest.fixture(scope="module")
def tokenizers():
    return {
        cls: load_tokenizer(open(tokenizer_path(name), "rb").read())
        for cls, name in ((WordEncoder, "word_bpe_49k.json"), (ByteEncoder, "byte_bpe_50k.json"))
    }


def plain_ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("kind", [WordEncoder, ByteEncoder])
def test_ids_equal_the_library(tokenizers, kind):
    encoder = kind(tokenizers[kind])
    encoder.pieces.limit = 40  # most pieces are not kept

    @settings(max_examples=150, deadline=None)
    @for_all(st.lists(st.text(alphabet=" \n\t\xa0 \x1caéÉZ'sß~1.,!?#漢é🙂İΣ​", max_size=25), max_size=6))
    def check(texts):
        ids, counts = encoder(pa.array(texts, pa.string()))
        expected = [plain_ids(encoder.tokenizer, t) for t in texts]
        assert counts.tolist() == [len(e) for e in expected]
        assert ids.tolist() == [i for e in expected for i in e]

    check()


@settings(max_examples=100, deadline=None)
@for_all(st.lists(st.sampled_from([0, 1, 255, 256, 65535, 65536, 16777215, 16777216, 2**32 - 1])))
def test_numbers_round_trip(values):
    control, data = token_files.encode_numbers(np.array(values, np.uint32))
    assert token_files.decode_numbers(control, data, len(values)).tolist() == values


def test_token_files(spark, given, odd_docs, tokenizers):
    for docs in (given("documents"), odd_docs):
        path = work_dir(spark, "test-files")
        token_files.write_token_files(docs, path, tokenizer_path("word_bpe_49k.json"), 2)
        found = rows_of(token_files.read_token_files(spark, path))
        expected = []
        for r in rows_of(docs.select("doc_id", "text")):
            ids = plain_ids(tokenizers[WordEncoder], r["text"]) + [2]
            expected.append((r["doc_id"], len(ids), np.array(ids, "<u4").tobytes()))
        assert sorted(map(repr, ((r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in found))) == sorted(map(repr, expected))
        found.sort(key=lambda r: r["start"])
        assert [r["start"] for r in found] == np.cumsum([0] + [r["n_tokens"] for r in found])[:-1].tolist()
        ids = [r["doc_id"] for r in found if r["doc_id"] is not None]
        assert ids == sorted(ids)
        ranks = sorted(rows_of(spark.read.parquet(f"{path}/ranks")), key=lambda r: r["rank"])
        assert [r["n"] for r in ranks] == sorted((r["n"] for r in ranks), reverse=True)
        assert sum(r["n"] for r in ranks) == sum(e[1] for e in expected)


def test_token_files_of_no_documents(spark, no_docs):
    path = work_dir(spark, "test-files")
    token_files.write_token_files(no_docs, path, tokenizer_path("word_bpe_49k.json"), 2)
    assert token_files.read_token_files(spark, path).count() == 0


def check_packing(found, docs, tokenizer, capacity):
    expected = sorted(repr((r["doc_id"], plain_ids(tokenizer, r["text"]) + [0])) for r in rows_of(docs.select("doc_id", "text")))
    by_sequence, by_doc = {}, {}
    for r in found:
        assert r["length"] <= capacity and r["length"] * 4 == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(r["ids"])
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    again = []
    for doc_id, parts in by_doc.items():
        if len({r["piece"] for r in parts}) < len(parts):
            continue  # rows that share an id: compared by their pieces' number only
        parts.sort(key=lambda r: r["piece"])
        assert all(r["length"] == capacity for r in parts[1:])
        assert [r["start"] for r in parts] == np.cumsum([0] + [r["length"] for r in parts])[:-1].tolist()
        again.append(repr((doc_id, np.frombuffer(b"".join(r["ids"] for r in parts), "<u4").tolist())))
    assert set(again) <= set(expected)
    assert sum(r["length"] for r in found) == sum(len(eval(e)[1]) for e in expected)
    return len(by_sequence)


@pytest.mark.parametrize("capacity", [2048, 50])
def test_packing(given, odd_docs, tokenizers, capacity):
    for docs in (given("documents"), odd_docs):
        found = rows_of(packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), 0, capacity))
        used = check_packing(found, docs, tokenizers[ByteEncoder], capacity)
        least = -(-sum(r["length"] for r in found) // capacity)
        assert used <= least * 1.03 + 2


WORKER = """
import random, resource, types
import pyarrow as pa
from tabquest.llm import packing
from tabquest.llm.shared import tokenizer_path

path = tokenizer_path("byte_bpe_50k.json")
cuts = []
docs = types.SimpleNamespace(sparkSession=None, mapInArrow=lambda cut, schema: cuts.append(cut))
packing.prepare = lambda spark: spark
packing.documents_of = lambda docs: docs
packing.broadcast_file = lambda spark, path: types.SimpleNamespace(value=open(path, "rb").read())
packing.TaskContext = types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0))
packing.tokenised_pieces(docs, path, 0, 2048)

draw = random.Random(3)
def batches(sizes):
    for n in sizes:
        texts = [" ".join("%x" % draw.getrandbits(40) for _ in range(400)) for _ in range(n)]
        yield pa.RecordBatch.from_pydict({"doc_id": list(range(n)), "text": texts})

peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
sum(b.num_rows for b in cuts[0](batches([10])))
before = peak()
sum(b.num_rows for b in cuts[0](batches([1000, 1000])))
print(peak() - before)
"""


def test_packing_worker_memory():
    """What a worker takes for many distinct words beyond its tokenizer; two batches of 4.4 MB here."""
    root = str(Path(packing.__file__).resolve().parents[2])
    env = os.environ | {"PYTHONPATH": root}
    done = subprocess.run([sys.executable, "-c", WORKER], env=env, capture_output=True, text=True, timeout=300, check=True)
    assert int(done.stdout) < 200


def test_packing_of_no_documents(no_docs):
    assert packing.pack(no_docs, tokenizer_path("byte_bpe_50k.json")).count() == 0


@settings(max_examples=200, deadline=None)
@for_all(st.integers(3, 40).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 30)))))
def test_plan(case):
    capacity, counts = case
    runs = packing.plan_runs(counts, capacity)
    fill, ranks, large = {}, {}, {}
    for length, first, last, sequence, per_sequence, offset in runs:
        for rank in range(first, last + 1):
            ranks.setdefault(length, []).append(rank)
            step = rank - first
            where = sequence + step // per_sequence
            fill.setdefault(where, []).append((offset + step % per_sequence * length, length))
            large[where] = large.get(where, 0) + (length > capacity // 3)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    for parts in fill.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    assert max(large.values(), default=0) <= 2
    if counts:  # best fit uses at most 11/9 of the best number, and a bin more
        assert len(fill) <= 11 / 9 * -(-sum(k * n for k, n in counts.items()) // capacity) * 1.5 + 1
