"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Base spans (leftmost, non-overlapping per kind; a match that fails its test is dropped without a retry): ``email``,
``ip`` (parts at most 255), ``card`` (14 to 19 digits, Luhn), ``phone`` (10 to 15 digits after a plus sign).  They
always count.  Further kinds need a score of ``ACCEPT``: a pattern's own weight, plus what a checksum confirms
(mod-97 of an IBAN of its country's length, whatever follows it after a blank; Luhn of a 13-digit card), plus or minus context words within ``WINDOW`` characters.  A further
span that touches a base span, or an accepted one before it, is left out.

Defined results: a null or empty text has no span; offsets are code points, end exclusive; whole texts of any
length are read in one linear pass per kind; repeated rows give repeated rows; an empty table gives an empty table; of further
spans that start at the same place the kind listed first wins; columns of the input that clash with the result's are ignored by
``report`` and replaced by ``personal_data``.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dawnframe.llm.arrow import add_columns

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "national_id", "local_phone", "short_card")
ORDER = {kind: i for i, kind in enumerate(KINDS)}
ACCEPT = 0.6
WINDOW = 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Where an account number may start, and its further characters, each with the blank before it.
_IBAN = re.compile(r"(?<![A-Za-z0-9])(?=([A-Z]{2})[0-9]{2}((?: ?[A-Z0-9]){11,30}))")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])(?:\([0-9]{2,4}\)|0?[0-9]{2,4})[ ./-][0-9]{3,4}[ ./-][0-9]{3,5}(?![0-9-])")

#: Words near a candidate that raise its score, by kind, and words that lower any score.
CONTEXT = {
    "iban": {"iban", "account", "konto", "compte", "cuenta", "bank", "transfer"},
    "national_id": {"ssn", "social", "security", "id", "identity", "ausweis", "dni"},
    "local_phone": {"phone", "tel", "telephone", "telefon", "téléphone", "teléfono", "call", "mobile", "fax"},
    "short_card": {"card", "visa", "credit", "debit", "karte", "carte", "tarjeta"},
}
AGAINST = {"order", "version", "isbn", "serial", "invoice", "sku", "test", "example"}
#: Characters of an IBAN by country, from the public registry.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18,
    "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24,
    "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
#: (pattern's own weight, what a confirmed checksum adds, what a context word adds)
WEIGHTS = {"iban": (0.2, 0.6, 0.2), "national_id": (0.4, 0.0, 0.3), "local_phone": (0.3, 0.0, 0.4), "short_card": (0.1, 0.3, 0.3)}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, end := m.end(), "email"))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], ORDER[s[2]]))


def _score(text: str, start: int, end: int, kind: str, confirmed: bool) -> float:
    own, checksum, context = WEIGHTS[kind]
    near = set(re.findall(r"\w+", text[max(0, start - WINDOW) : start].lower() + " " + text[end : end + WINDOW].lower()))
    return own + checksum * confirmed + context * bool(near & CONTEXT[kind]) - 0.2 * bool(near & AGAINST)


def _ibans(text: str):
    """(start, end, kind, confirmed): of a listed country by its length, of another by any length whose checksum holds, longest first."""
    for m in _IBAN.finditer(text):
        run, n, ends = m[2], 4, {}
        for i, c in enumerate(run):
            if c != " ":
                n += 1
                if i + 1 == len(run) or run[i + 1] == " " or n in (IBAN_LENGTHS.get(m[1]),):
                    ends[n] = m.start(2) + i + 1
        wanted = [IBAN_LENGTHS[m[1]]] if m[1] in IBAN_LENGTHS else sorted(ends, reverse=True)
        for n in wanted:
            end = ends.get(n)
            if n >= 15 and end is not None and not (text[end : end + 1].isascii() and text[end : end + 1].isalnum()) and mod97(text[m.start() : end].replace(" ", "")):
                yield m.start(), end, "iban", True
                break


def more_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """What the scored candidates add to the base spans."""
    proposed = list(_ibans(text))
    proposed += [(m.start(), m.end(), "national_id", False) for m in _NATIONAL.finditer(text)]
    proposed += [(m.start(), m.end(), "local_phone", False) for m in _LOCAL_PHONE.finditer(text)]
    proposed += [(m.start(), m.end(), "short_card", luhn(d)) for m in _CARD.finditer(text) if m.end() - m.start() < 26 and len(d := _digits(m[0])) == 13]
    taken, i, last, out = sorted(base), 0, 0, []
    for start, end, kind, confirmed in sorted(proposed, key=lambda s: (s[0], ORDER[s[2]])):
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        if start >= last and (i == len(taken) or taken[i][0] >= end) and _score(text, start, end, kind, confirmed) >= ACCEPT:
            out.append((start, end, kind))
            last = end
    return out


_ANY = re.compile(r"[0-9@]")


def find(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans), each by start and then kind."""
    if not text or not _ANY.search(text):
        return [], []
    base = base_spans(text)
    return base, sorted(base + more_spans(text, base), key=lambda s: (s[0], ORDER[s[2]]))


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("base", T.BooleanType())]))
_SPAN_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_())]))


def personal_data(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """``docs`` with ``text`` replaced by ``into``: array of (start, end, kind, base)."""

    def one(value):
        base, spans = find(value)
        marks = set(base)
        return ([{"start": s, "end": e, "kind": k, "base": (s, e, k) in marks} for s, e, k in spans],)

    return add_columns(docs, text, [(into, SPAN, _SPAN_ARROW)], lambda: one)


def report(docs: DataFrame) -> DataFrame:
    """One row for each document: counts of the base kinds, the digest of the base spans, and all spans as text."""
    fields = [(f"n_{k}", T.LongType(), pa.int64()) for k in BASE] + [("base_sha256", T.StringType(), pa.string()), ("spans", T.StringType(), pa.string())]

    def one(value):
        base, spans = find(value)
        kinds = [k for _, _, k in base]
        return (*map(kinds.count, BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))

    return add_columns(docs.select("doc_id", F.col("text")), "text", fields, lambda: one)


def redact(docs: DataFrame, mask: str = "<{}>") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by its kind; overlapping spans become one, named by the first."""

    def one(value):
        if value is None:
            return (None,)
        out, at = [], 0
        for start, end, kind in find(value)[1]:
            if start >= at:
                out += [value[at:start], mask.format(kind.upper())]
            at = max(at, end)
        return ("".join(out) + value[at:],)

    return add_columns(docs, "text", [("text", T.StringType(), pa.string())], lambda: one).select(docs.columns)
