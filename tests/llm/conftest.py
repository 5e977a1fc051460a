import os
import random

import pytest
from llm_helpers import SF_DIR

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "fingerprint string, root int, n double, hits string, part string, length string, spans int, score string"
)


@pytest.fixture(scope="session")
def given(spark):
    """The smallest given tables, by name."""
    if not os.path.isdir(SF_DIR):
        pytest.skip("given tables not found")
    return lambda name: spark.read.parquet(f"{SF_DIR}/{name}.parquet")


def odd_texts():
    """Nulls, empty and odd texts, repeated ones, long ones."""
    rng = random.Random(7)
    words = ["alpha", "Beta,", "gamma.", "  ", "\n", "été", "x", "漢字", "don't", "12", "<b>", "a b", "🙂", "ñ"]
    texts = [None, "", " ", "\n\n", "one", "one two", "One  two\tthree", "same text here again", "same text here again"]
    texts += ["\ttabs and\xa0nbsp  wide", "<|endoftext|> ~ </w> ▁", "é combined", "\x00 control \x1c x", " lead", "trail "]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(30)]
    texts.append("word " * 30_000)  # long
    texts.append("x" * 50_000)  # one long word
    return texts


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd documents with null and repeated ids and columns whose names clash with the operators'."""
    rows = [(i, t, "en" if i % 3 else None, "s", len(t or ""), "f", 1, 2.0, "h", "p", "l", 3, "z") for i, t in enumerate(odd_texts())]
    rows += [(None, "no id", None, None, None) + (None,) * 8, (3, rows[3][1], *rows[3][2:]), (3, "another text", "de", "s", 5) + (None,) * 8]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
