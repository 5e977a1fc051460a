"""Secrets against regular expressions and plain arithmetic in Python."""

import hashlib
import math
import random
import re
import string

from llm_helpers import SF_DIR, rows_of

from tabquest.llm import secrets
from tabquest.llm.queries import QUERIES

ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""")
RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")


def base_spans(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
    return sorted(found)


def runs_of(text):
    """(start, end, run) of the runs between assignments."""
    at = 0
    for part_end, next_at in [*((m.start(), m.end()) for m in ASSIGN.finditer(text)), (len(text), None)]:
        for m in RUN.finditer(text[at:part_end]):
            if not re.search("AKIA[A-Z0-9]{14}|[0-9a-f]{16}", m.group()):
                yield at + m.start(), at + m.end(), m.group().rstrip("=")
        at = next_at


def encoding(run):
    for name, (alphabet, needed) in secrets.ENCODINGS.items():
        if set(run) <= set(alphabet) and all(re.search(p, run) for p in needed):
            return name
    return None


def step(run):
    alphabet = secrets.ENCODINGS[encoding(run)][0]
    n, k = len(run), len(alphabet)
    pairs = sum(run[i] == run[j] for i in range(n) for j in range(i))
    z = [(math.sqrt(pairs) + math.sqrt(pairs + 1) - math.sqrt(2 * n * (n - 1) / k + 1)) / math.sqrt(1 - 1 / k)]
    v = [alphabet.index(c) + 1 for c in run]
    changes = sum((x > k / 2) != (y > k / 2) for x, y in zip(v, v[1:]))
    excess = abs(changes - (n - 1) / 2) - 0.5
    z.append(max(excess, 0) / math.sqrt((n - 1) / 4))
    z.append(sum((x - (k + 1) / 2) * (y - (k + 1) / 2) for x, y in zip(v, v[1:])) / ((k * k - 1) / 12 * math.sqrt(n - 1)))
    p = [max(math.erfc(abs(x) / math.sqrt(2)), 1e-30) for x in z]
    total = sum(math.tan((0.5 - min(q, 0.99)) * math.pi) for q in p) / 3
    return min(max(-math.log10(math.atan2(1, total) / math.pi) * 4, 0), 40)


def plain_spans(texts):
    """Spans of each text; runs so near a step's edge that the approximation may move them are given apart."""
    runs = {run: step(run) for text in texts for _, _, run in runs_of(text) if encoding(run)}
    groups = {}
    for run, s in runs.items():
        groups.setdefault((encoding(run), int(math.log2(len(run)))), []).append(int(s))
    limit = {}
    for key, steps in groups.items():
        good = [j for j in range(41) if any(s >= j for s in steps) and 10 ** (-j / 4) * len(steps) <= 0.02 * sum(s >= j for s in steps)]
        limit[key] = min(good, default=99)
    spans = []
    for text in texts:
        own = base_spans(text)
        own += [(a, 3, b, "random") for a, b, run in runs_of(text) if encoding(run) and int(runs[run]) < limit[(encoding(run), int(math.log2(len(run))))]]
        spans.append(sorted(own))
    close = {run for run, s in runs.items() if 0 < s < 40 and abs(s - round(s)) < 2e-4}
    return spans, close


def random_run(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


def texts_with_secrets():
    rng = random.Random(3)
    b62, b64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    words = ["alpha", "été", "the", "🙂", "password:", "token=", "Secret = '", "api_key", "apikey\": \"", "x-y_z", "\n", "漢字"]
    texts = ["", "no secrets", "token = " + "a" * 11, "token=secret: abcdefghijklmnop", "PASSWD:'" + "Z.=-" * 4 + "'", "Key api_Key=abcdefghijklmnop"]
    texts += ["AKIA" + "A" * 13, "xAKIAAKIA" + "B2" * 8 + "é", "0123456789abcdef0 " * 3, "ffffffffffffffff", "AKIA" * 5 + " 🙂 " + "0" * 40]
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 30)):
            kind = rng.randrange(6)
            parts.append(
                rng.choice(words) if kind < 4 else random_run(rng, rng.choice([b62, b64, "0123456789abcdef", "0123456789ABCDEF"]), rng.randint(8, 70)) if kind == 4
                else rng.choice(["/usr/local/share/documents/And_Reports", "getCustomerAccountBalanceForPeriod", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnop", "aaaaaaaaaaaaaaaaaaaaaaaaA1"])
            )
        texts.append(rng.choice([" ", ""]).join(parts))
    return texts


def check(found, texts):
    expected, close = plain_spans(texts)
    assert not close
    for text, want, spans in zip(texts, expected, found):
        assert [(s["start"], s["rank"], s["end"], s["kind"]) for s in spans] == want, text


def test_spans_equal_those_of_plain_python(spark):
    texts = texts_with_secrets()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r["spans"] for r in rows_of(secrets.find_secrets(docs))}
    check([found[i] for i in range(len(texts))], texts)


def test_random_runs_are_found_and_others_left(spark):
    rng = random.Random(8)
    b62 = string.ascii_letters + string.digits
    runs = [random_run(rng, b62, rng.randint(24, 60)) for _ in range(200)]
    words = ["Account", "customer", "Balance", "report", "Document", "number", "Index", "total", "2024", "History", "value", "Order", "Line"]
    names = ["".join(rng.choice(words) for _ in range(6)) for _ in range(200)]
    docs = spark.createDataFrame([(i, f"see {r} here") for i, r in enumerate(runs + names)], "doc_id long, text string")
    found = {r["doc_id"] for r in rows_of(secrets.find_secrets(docs)) if any(s["kind"] == "random" for s in r["spans"])}
    assert sum(i in found for i in range(200)) >= 190
    assert sum(i in found for i in range(200, 400)) <= 4


def test_one_text_with_many_matches(spark):
    text = " ".join(["0123456789abcdef"] * 20_000) + " é token=" + "Ab1" * 9
    (row,) = rows_of(secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    assert [(s["start"], s["rank"], s["end"], s["kind"]) for s in row["spans"]] == base_spans(text)


def test_query_over_given_documents(spark, given):
    rows = rows_of(given("documents").select("doc_id", "text"))
    spans, _ = plain_spans([r["text"] or "" for r in rows])
    found = {r["doc_id"]: r for r in rows_of(QUERIES["op11_secrets"](spark, SF_DIR))}
    for r, own in zip(rows, spans):
        got = found[r["doc_id"]]
        base = ",".join(f"{k}:{a}:{b}" for a, rank, b, k in own if rank < 3)
        assert got["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [got[f"n_{k}"] for k in secrets.BASE_KINDS] == [sum(s[3] == k for s in own) for k in secrets.BASE_KINDS]
        assert got["spans"] == ",".join(f"{k}:{a}:{b}" for a, _, b, k in own)


def test_odd_documents(odd_docs, no_docs):
    rows = rows_of(odd_docs)
    found = rows_of(secrets.find_secrets(odd_docs))
    key = lambda r: repr((r["doc_id"], [s["start"] for s in r["spans"]]))
    spans, _ = plain_spans([r["text"] or "" for r in rows])
    assert sorted(map(key, found)) == sorted(repr((r["doc_id"], [s[0] for s in own])) for r, own in zip(rows, spans))
    assert secrets.find_secrets(no_docs).count() == 0
