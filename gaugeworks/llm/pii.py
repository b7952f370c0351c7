"""Personal data: expressions propose spans, check digits confirm them, words near by adjust the score.

Four base kinds follow fixed rules and always stay (see ``BASE``); three more
are proposed by expressions of their own, confirmed by ISO 7064 mod 97 where the
format has check digits, and kept if their score reaches ``KEEP``. A score starts
at the kind's prior, rises with a passed check and with a word of its kind within
``NEAR`` characters before or after the span, and falls with a word that speaks
against it. An IBAN has its country's length, in either case of letters.

Every expression is linear in the text: runs are possessive, and an address is
looked up from its at sign, so a long run of letters or digits costs one pass.

Defined cases: a null or empty text has no spans; positions are code points,
ends exclusive; rows are independent of each other and of other columns.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import sha256
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "phone_local")
KINDS = BASE + ADDED
ORDER = {k: i for i, k in enumerate(KINDS)}
NEAR, KEEP = 48, 0.6

_domain = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[ -]?[0-9])++")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_iban = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2}(?= ?[A-Za-z0-9])")
#: How many characters an IBAN of a country has.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30,
    "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23,
    "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
_ssn = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_phone_local = re.compile(r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9])")

PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.5, "phone": 0.6, "iban": 0.4, "ssn": 0.4, "phone_local": 0.4}
CHECKED = {"card": 0.3, "iban": 0.4}
FOR = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|correo|courriel)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address|adresse)\b", re.I),
    "card": re.compile(r"\b(?:card|credit|visa|mastercard|payment|karte|carte|tarjeta)\b", re.I),
    "phone": re.compile(r"\b(?:tel|phone|call|mobile|fax|telefon|téléphone|teléfono)\b", re.I),
    "iban": re.compile(r"\b(?:iban|account|bank|konto|compte|cuenta)\b", re.I),
    "ssn": re.compile(r"\b(?:ssn|social|security|insurance)\b", re.I),
    "phone_local": re.compile(r"\b(?:tel|phone|call|mobile|fax|telefon|téléphone|teléfono)\b", re.I),
}
AGAINST = re.compile(r"\b(?:isbn|version|order|invoice|serial|sku|example)\b", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """An IBAN's check: the country and check digits go to the end, letters count 10 to 35, the rest by 97 is 1."""
    rest = 0
    for c in code[4:] + code[:4]:
        n = int(c, 36)
        rest = (rest * (100 if n > 9 else 10) + n) % 97
    return rest == 1


def _digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0
    for m in _domain.finditer(text):
        start = at = m.start()
        while start > free and text[start - 1] in _local:
            start -= 1
        if start < at:
            free = m.end()
            yield start, free


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    if "@" in text:
        yield from (("email", a, b) for a, b in emails(text))
    for m in _ip.finditer(text):
        if all(len(x := part.lstrip("0")) < 4 and int(x or "0") <= 255 for part in m[0].split(".")):
            yield "ip", *m.span()
    for m in _card.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", *m.span()
    if "+" in text:
        for m in _phone.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                yield "phone", *m.span()


def added_spans(text: str) -> Iterator[tuple[str, int, int]]:
    for m in _iban.finditer(text):
        end = iban_end(text, m.start())
        if end and mod97(text[m.start() : end].replace(" ", "").upper()):
            yield "iban", m.start(), end
    if "-" in text:
        for m in _ssn.finditer(text):
            if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
                yield "ssn", *m.span()
    for m in _phone_local.finditer(text):
        yield "phone_local", *m.span()


def iban_end(text: str, start: int) -> int:
    """Where the characters of the country's length end, single spaces between them aside; 0 if they don't stand alone."""
    left, at = IBAN_LENGTH.get(text[start : start + 2].upper(), 0), start
    if not left:
        return 0
    while left:
        c = text[at : at + 1]
        if c == " " and text[at - 1] != " ":
            at += 1
        elif c.isascii() and c.isalnum():
            at, left = at + 1, left - 1
        else:
            return 0
    after = text[at : at + 1]
    return 0 if after.isascii() and after.isalnum() else at


def score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - NEAR) : start] + "\n" + text[end : end + NEAR]
    value = PRIOR[kind] + CHECKED.get(kind, 0) + 0.2 * bool(FOR[kind].search(near)) - 0.2 * bool(AGAINST.search(near))
    return round(min(1.0, max(0.0, value)), 3)


def find(text: str | None) -> list[tuple[int, int, int, str, float]]:
    """(start, place of the kind, end, kind, score) of all spans, in that order."""
    if not text:
        return []
    out = [(a, ORDER[k], b, k, score(text, k, a, b)) for k, a, b in base_spans(text)]
    taken = sorted((a, b) for a, _, b, _, _ in out)
    starts, ends = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    for k, a, b in added_spans(text):
        before = bisect_left(starts, b)  # of the spans that begin before this one's end, the largest end
        s = score(text, k, a, b)
        if s >= KEEP and not (before and ends[before - 1] > a):
            out.append((a, ORDER[k], b, k, s))
    return sorted(out)


def redact(text: str | None, spans: list[tuple[int, int, int, str, float]]) -> str | None:
    """The text with every span replaced by its kind in angle brackets; spans that overlap become one."""
    if text is None:
        return None
    out, at = [], 0
    for a, _, b, k, _ in spans:
        if a >= at:
            out += [text[at:a], f"<{k}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, redacted: bool = False) -> DataFrame:
    """A row per row: doc_id, spans as array<struct<start, end, kind, score>>, counts of the base kinds, and the redacted text if asked for."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, found array<struct<start:long,end:long,kind:string,score:double>>, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string" + ", text string" * redacted
    kind_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [find(t) for t in texts]
            said = [[f"{k}:{a}:{b}" for a, _, b, k, _ in f] for f in found]
            base = [",".join(s for s, x in zip(names, f, strict=True) if x[1] < len(BASE)) for names, f in zip(said, found, strict=True)]
            columns = [
                batch.column("doc_id"),
                pa.array([[{"start": a, "end": b, "kind": k, "score": s} for a, _, b, k, s in f] for f in found], kind_type),
                *(pa.array([sum(x[1] == i for x in f) for f in found], pa.int64()) for i in range(len(BASE))),
                pa.array([sha256(b.encode()).hexdigest() for b in base], pa.string()),
                pa.array([",".join(s) for s in said], pa.string()),
            ]
            names = ["doc_id", "found", *(f"n_{k}" for k in BASE), "base_sha256", "spans"]
            if redacted:
                columns.append(pa.array([redact(t, f) for t, f in zip(texts, found, strict=True)], pa.string()))
                names.append("text")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, and ``scores``: those of all spans, in their order."""
    found = find_pii(table(spark, sf_dir, "documents"))
    return found.withColumn("scores", F.array_join(F.transform("found", lambda f: F.format_string("%.3f", f["score"])), ",")).drop("found")
