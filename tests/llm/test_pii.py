"""Personal data against the plain patterns, and the rules of the further kinds."""

import hashlib
import re

import pytest
from hypothesis import given as for_all
from hypothesis import settings
from hypothesis import strategies as st
from llm_helpers import SF_DIR, rows_of
from pyspark.sql import functions as F

from tabquest.llm import pii
from tabquest.llm.queries import op6_pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def plain_base(text):
    found = [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    return found + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def base_of(text):
    return [s[:3] for s in pii.find_spans(text) if s[0] in pii.BASE_KINDS]


@settings(max_examples=1500, deadline=None)
@for_all(
    st.lists(
        st.sampled_from(["@", "a", "b.c", ".", "..", "-", "+", "1", "25", "256", "1.2", "+1 (017) 555-7713", " ", "é", "4111 1111", "x@y.z", "%"])
    ).map("".join)
)
def test_base_spans_equal_the_patterns(text):
    assert base_of(text) == plain_base(text)


def test_parts_of_an_address_may_have_any_number_of_zeros():
    zeros = "0" * 5000
    assert base_of(f"{zeros}.0.0.0") == [("ip", 0, 5006)]
    assert base_of(f"a 1.{zeros}255.{zeros}.7") == [("ip", 2, 2 + 5003 + 5002 + 3)]
    assert base_of(f"1.2.3.{zeros}256") == []


def test_documents(spark, given):
    by_id = {r["doc_id"]: r["text"] for r in rows_of(given("documents"))}
    found = rows_of(op6_pii(spark, SF_DIR))
    assert len(found) == len(by_id)
    for r in found:
        base = plain_base(by_id[r["doc_id"]] or "")
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[0] == k for s in base) for k in pii.BASE_KINDS]
        assert r["spans"].startswith(listed)


def test_checks_and_context():
    def kinds(text):
        return [s[0] for s in pii.find_spans(text)]

    assert kinds("pay DE89 3704 0044 0532 0130 00 now") == ["iban"]
    assert kinds("pay DE88 3704 0044 0532 0130 00 now") == []  # fails mod 97
    assert kinds("4111 1111 1111 1111") == ["card"]
    assert kinds("4111 1111 1111 1112") == []  # fails Luhn
    assert kinds("social security 123-45-6789") == ["ssn"]
    assert kinds("part 123-45-6789") == []
    assert kinds("call (030) 123 4567") == ["local_phone"]
    assert kinds("(030) 123 4567") == []
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB83WEST12345698765432")


def test_long_texts_take_linear_time():
    for text in ("a" * 200_000, "@" * 200_000, "1" * 200_000, "1." * 100_000, "+1 " * 60_000, "a@b" * 60_000):
        pii.find_spans(text)


def test_masking(given, odd_docs, no_docs):
    odd = odd_docs.select(F.col("doc_id") + 10**6, F.concat("text", F.lit(" a@b.cc +1 (017) 555-7713")), "lang", "source", "n_chars")
    docs = given("documents").union(odd)
    masked = pii.mask_pii(docs)
    assert masked.schema == docs.schema
    expected = []
    for r in rows_of(docs):
        spans = pii.find_spans(r["text"] or "")
        text = pii.masked(r["text"], spans) if spans else r["text"]
        expected.append((r["doc_id"], text, len(text) if spans and r["n_chars"] is not None else r["n_chars"]))
        assert text is None or plain_base(text) == []
    assert sorted(map(repr, expected)) == sorted(repr((r["doc_id"], r["text"], r["n_chars"])) for r in rows_of(masked))
    assert pii.mask_pii(odd_docs).schema == odd_docs.schema
    assert pii.mask_pii(no_docs).count() == 0 and pii.find_pii(no_docs).count() == 0


def test_overlapping_spans_become_one():
    assert pii.masked("abcdefgh", [("card", 2, 5, 1.0), ("ip", 3, 7, 1.0)]) == "ab<CARD>h"


@pytest.mark.parametrize(
    "text, start, end",
    [
        ("IBAN DE89370400440532013000 BIC COBADEFF", 5, 27),
        ("DE89 3704 0044 0532 0130 00 AND MORE", 0, 27),
        ("GB82WEST12345698765432 PLEASE PAY", 0, 22),
        ("to NO93 8601 1117 947.", 3, 21),
    ],
)
def test_an_iban_ends_where_its_country_says(text, start, end):
    assert [s[:3] for s in pii.find_spans(text) if s[0] == "iban"] == [("iban", start, end)]


@pytest.mark.parametrize("text", ["DE89370400440532013001 X", "DE8937040044053201300 X", "ZZ89370400440532013000", "xDE89370400440532013000", "DE89370400440532013000A"])
def test_no_iban(text):
    assert "iban" not in [s[0] for s in pii.find_spans(text)]


def test_context_on_either_side():
    assert [s[0] for s in pii.find_spans("123-45-6789 is my social security number")] == ["ssn"]
    assert pii.find_spans("123-45-6789 is a number") == []
