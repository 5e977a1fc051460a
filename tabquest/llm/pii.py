"""Personal data in text: patterns propose spans, checks confirm them, nearby words adjust the score.

Kinds whose pattern and check suffice (email, ip, card, phone) are always reported.  Further
ones (iban, ssn, local_phone) are reported if their score reaches ``LEAST_SCORE``: the pattern gives
a part of it, a passed check sum (mod 97 over an IBAN of its country's length) or a word of the kind within
``CONTEXT_CHARS`` code points before or behind the span the rest; words before it that speak against it take some away.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabquest.llm.shared import bounded, documents_of, prepare

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = BASE_KINDS + ("iban", "ssn", "local_phone")
LEAST_SCORE = 0.6
CONTEXT_CHARS = 40
SPAN_TYPE = "array<struct<kind:string,start:int,end:int,score:double>>"

# Patterns of the base kinds.  Possessive repeats match the same texts without retries.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Patterns of the further kinds.
_IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
# Length of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22,
    "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27,
    "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31,
    "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
_IBAN = {n: re.compile(rf"[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in set(IBAN_LENGTHS.values())}
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{2,5}\)|0[0-9]{1,4})[ /-]?[0-9]{2,4}(?:[ -]?[0-9]{2,4}){1,3}(?![0-9])")
_CANDIDATE = "[0-9@]"

_FOR = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social", "security"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"),
}
_AGAINST = ("version", "isbn", "order", "invoice", "id", "ref", "serial", "part")
_BASE_SCORE = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.4, "ssn": 0.4, "local_phone": 0.3}
_WORD = re.compile(r"\w+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        value = int(d) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from every @ outwards: linear also in long words."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and (text[start - 1] in "._%+-" or (text[start - 1].isascii() and text[start - 1].isalnum())):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _base(text: str) -> Iterator[tuple[str, int, int]]:
    for start, end in _emails(text):
        yield "email", start, end
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield "card", *m.span()
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            yield "phone", *m.span()


def _further(text: str) -> Iterator[tuple[str, int, int, float]]:
    """With what the check adds to the score."""
    for head in _IBAN_HEAD.finditer(text):
        length = IBAN_LENGTHS.get(head[0][:2])
        m = _IBAN[length].match(text, head.start()) if length else None
        if m and mod97(m[0].replace(" ", "")):
            yield "iban", *m.span(), 0.5
    for m in _SSN.finditer(text):
        yield "ssn", *m.span(), 0.0
    for m in _LOCAL_PHONE.finditer(text):
        if 7 <= len(_digits(m[0])) <= 12:
            yield "local_phone", *m.span(), 0.0


def _context(text: str, kind: str, start: int, end: int) -> float:
    words = _WORD.findall(text[max(0, start - CONTEXT_CHARS) : start].lower())
    behind = _WORD.findall(text[end : end + CONTEXT_CHARS].lower())
    score = 0.4 if any(w.startswith(_FOR[kind]) for w in words + behind) else 0.0
    return score - (0.2 if any(w in _AGAINST for w in words) else 0.0)


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as listed, then start; ends are exclusive, in code points."""
    spans = []
    for kind, start, end in _base(text):
        spans.append((kind, start, end, min(1.0, max(LEAST_SCORE, _BASE_SCORE[kind] + _context(text, kind, start, end)))))
    taken = [(s, e) for _, s, e, _ in spans]
    for kind, start, end, checked in _further(text):
        score = min(1.0, _BASE_SCORE[kind] + checked + _context(text, kind, start, end))
        if score >= LEAST_SCORE and not any(s < end and start < e for s, e in taken):
            spans.append((kind, start, end, score))
            taken.append((start, end))
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))


def masked(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one."""
    parts, end = [], 0
    for kind, start, stop, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= end:
            parts += [text[end:start], f"<{kind.upper()}>"]
        end = max(end, stop)
    return "".join(parts) + text[end:]


def _spans_of(texts: pa.Array) -> list[list[tuple]]:
    found: list[list[tuple]] = [[] for _ in range(len(texts))]
    hit = pc.match_substring_regex(texts, _CANDIDATE).to_numpy(zero_copy_only=False).nonzero()[0]
    for i, text in zip(hit, texts.take(pa.array(hit)).to_pylist()):
        found[i] = find_spans(text)
    return found


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans`` (kind, start, end, score) of every row.

    A null or empty text has none; repeated rows and null doc_ids stay; an empty table gives no
    rows; other columns are ignored.
    """
    prepare(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bounded(whole, "text"):
                spans = [
                    [dict(zip(("kind", "start", "end", "score"), s)) for s in found]
                    for found in _spans_of(batch.column("text"))
                ]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    return documents_of(docs).mapInArrow(run, f"doc_id long, spans {SPAN_TYPE}")


def count_kind(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind))


def span_text(spans, kinds: tuple[str, ...] | None = None):
    """kind:start:end of the spans (of some kinds only), joined by commas."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def mask_pii(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` with personal data in ``text`` replaced by its kind.

    ``n_chars``, where present and not null, becomes the new length of a changed text.  Null
    texts stay null; rows without personal data stay as they are.
    """
    prepare(docs.sparkSession)
    names = docs.columns
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bounded(whole, "text"):
                spans = _spans_of(pc.fill_null(batch.column(place), ""))
                changed = [i for i, s in enumerate(spans) if s]
                if changed:
                    texts = batch.column(place).to_pylist()
                    for i in changed:
                        texts[i] = masked(texts[i], spans[i])
                    batch = batch.set_column(place, names[place], pa.array(texts, batch.column(place).type))
                    if names.count("n_chars") == 1:
                        at = names.index("n_chars")
                        sizes = batch.column(at).to_pylist()
                        for i in changed:
                            sizes[i] = len(texts[i]) if sizes[i] is not None else None
                        batch = batch.set_column(at, "n_chars", pa.array(sizes, batch.column(at).type))
                yield batch

    return docs.mapInArrow(run, docs.schema)
