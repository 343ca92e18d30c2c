"""Operator 2: personal data by anchor expansion."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "address", "login", "secret")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Cues in front of a value. An anchor is a cue as written here, capitalised or in capitals.
ACCOUNT_CUES = ("iban", "account number", "account no", "account", "acct", "routing number", "sort code", "konto", "kontonummer", "compte", "cuenta", "ssn", "social security number", "passport", "passport no")
SECRET_CUES = ("token", "api_key", "apikey", "api key", "secret", "password", "passwd", "access_key", "private_key", "bearer")
STREETS = ("street", "road", "avenue", "lane", "drive", "boulevard", "court", "square", "st.", "rd.", "ave.", "blvd.")
# Lengths of the account numbers of ISO 13616 by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27,
    "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28,
    "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28,
    "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
# Quantifiers with a second + give nothing back, so that long runs of white space cost their length only.
_ACCOUNT_LEAD = re.compile(r"(?:\s*+(?:number|no\.?|nr\.?|#))?+\s*+(?:[:=#]\s*+)?")
_ACCOUNT_NUMBER = re.compile(r"[A-Z]?[0-9](?:[ -]?[0-9]){5,19}(?![A-Za-z0-9])")
_NEXT_IBAN = re.compile(r"\s?[,;/&]?\s?(?:(?:and|or|und|et|y) )?")
_SECRET = re.compile(r"\s*+(?:=>|[:=])\s*+([\"']?)([A-Za-z0-9_+/=.\-]{8,})\1")
_LOGIN = re.compile(r"://([^\s/:@]+:[^\s/@]+)@[A-Za-z0-9.-]+")
_STREET_WORD = re.compile(r"[A-Z][A-Za-z'.-]*")
_HOUSE = re.compile(r"(?<![A-Za-z0-9])[0-9]{1,5}[A-Za-z]?,?\Z")
_AFTER_STREET = re.compile(r"(?:,? ++(?:Apt\.?|Suite|Unit|#) *+[A-Za-z0-9-]+)?(?:, *+[A-Z][A-Za-z'-]*+(?: [A-Z][A-Za-z'-]*+){0,3})?(?:,? ++[A-Z]{2})?(?:,? ++[0-9]{5}(?:-[0-9]{4})?)?(?![A-Za-z0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def iban_valid(value: str) -> bool:
    """ISO 13616: the country's length, and check digits: letters and digits whose number modulo 97 is 1."""
    s = value.replace(" ", "").upper()
    return s.isascii() and s.isalnum() and len(s) == IBAN_LENGTHS.get(s[:2]) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def iban_end(text: str, at: int) -> int | None:
    """The end of a valid account number that begins at `at`: as long as its country says, with single spaces inside, not
    followed by a letter or digit. What comes after it doesn't matter."""
    left, end = IBAN_LENGTHS.get(text[at : at + 2].upper(), 0), at
    while left:
        if end > at and text[end : end + 1] == " ":
            end += 1
        if not (c := text[end : end + 1]).isalnum() or not c.isascii():
            return None
        left, end = left - 1, end + 1
    if end == at or text[end : end + 1].isalnum():
        return None
    return end if iban_valid(text[at:end]) else None


@lru_cache(maxsize=1)
def _automaton():
    """Aho-Corasick over at-signs, schemes and cues: each anchor carries its kind and length."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES), ("address", STREETS)):
        for cue in cues:
            for form in {cue, cue.capitalize(), cue.title(), cue.upper()}:
                if kind != "address" or form[0].isupper():
                    found.add_word(form, (kind, len(form)))
    found.add_word("@", ("email", 1))
    found.add_word("://", ("login", 3))
    found.add_word("+", ("phone", 1))
    found.make_automaton()
    return found


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    domain = _DOMAIN.match(text, at)
    if domain is None:
        return None
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    return (start, domain.end()) if start < at else None


def _phone(text: str, at: int) -> tuple[int, int, bool] | None:
    m = _PHONE.match(text, at)
    return m and (at, m.end(), 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15)


def _accounts(text: str, at: int) -> list[tuple[int, int]]:
    """Account numbers after a cue that ends at `at`: valid IBANs, one or a list of them, or a number of a plausible length."""
    at = _ACCOUNT_LEAD.match(text, at).end()
    out: list[tuple[int, int]] = []
    while end := iban_end(text, at):
        out.append((at, end))
        at = _NEXT_IBAN.match(text, end).end()
    if not out and (m := _ACCOUNT_NUMBER.match(text, at)) and 6 <= sum(c.isdigit() for c in m[0]) <= 20:
        out.append(m.span())
    return out


def _house(text: str, at: int, floor: int) -> int | None:
    """Where the address begins whose street word is at `at`: a house number and one to four capitalised words, token by
    token backwards, however long they are."""
    words, end = 0, at
    while True:
        stop = end
        while stop > floor and text[stop - 1] == " ":
            stop -= 1
        if stop == end:
            return None
        start = stop
        while start > floor and not text[start - 1].isspace():
            start -= 1
        if start == stop:
            return None
        if words and (m := _HOUSE.search(text, max(start, stop - 7), stop)):
            return m.start()
        if words == 4 or not _STREET_WORD.fullmatch(text, start, stop):
            return None
        words, end = words + 1, start


def find_spans(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans (start, end), in code points, of each kind. Null is an empty text.

    email, ip, card and phone are the leftmost matches of their fixed forms, without overlap within a kind; a match that
    fails its check is dropped and not tried again. The other kinds need a cue: account (IBANs by their countries' lengths
    and check digits, or digits of a plausible length right after the cue), secret (a value of 8 or more after a cue and : or =), login (user:password@ in
    a URL), address (house number, capitalised words, street word, with unit, town, state and code where they follow).
    They never lie in a word that a cue only begins or ends.
    """
    out: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    if not text:
        return out
    ends, barren = dict.fromkeys(KINDS, 0), 0
    for last, (kind, length) in _automaton().iter(text):
        at = last - length + 1
        if at < ends[kind]:
            continue
        if kind == "email":
            if span := _email(text, at, ends["email"]):
                out["email"].append(span)
                ends["email"] = span[1]
        elif kind == "phone":
            if found := _phone(text, at):
                ends["phone"] = found[1]
                if found[2]:
                    out["phone"].append(found[:2])
        elif kind == "login":
            if m := _LOGIN.match(text, at):
                out["login"].append(m.span(1))
                ends["login"] = m.end()
        elif at and (text[at - 1].isalnum() or text[at - 1] == "_") or kind != "address" and text[last + 1 : last + 2].isalpha():
            continue
        elif kind == "secret":
            # A cue inside a value without digits, with more of it to come, could only take a part of the same value.
            if last + 2 < barren or not (m := _SECRET.match(text, last + 1)):
                continue
            if m[1] or any(c.isdigit() for c in m[2]):
                out["secret"].append(m.span(2))
                ends["secret"] = m.end()
            else:
                barren = m.end()
        elif kind == "account":
            if spans := _accounts(text, last + 1):
                out["account"] += spans
                ends["account"] = spans[-1][1]
        elif not text[last + 1 : last + 2].isalpha() and (start := _house(text, at, ends["address"])) is not None:
            end = _AFTER_STREET.match(text, last + 1)
            span = (start, end.end() if end else last + 1)
            out["address"].append(span)
            ends["address"] = span[1]
    for m in _DOTTED.finditer(text):
        # A run of numbers with dots between holds one match for each four of them; a run of digits is read once.
        if "." in m[0]:
            at, parts = m.start(), m[0].split(".")
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                end = at + sum(map(len, four)) + 3
                if all(int(x) <= 255 if len(x) < 4 else int(x[-3:]) <= 255 and not x[:-3].strip("0") for x in four):
                    out["ip"].append((at, end))
                at = end + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
    return out


def render(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in kinds for a, b in spans[kind])


def redact(text: str | None, spans: dict[str, list[tuple[int, int]]]) -> str | None:
    """The text with every span, longest first where they overlap, put as [kind]."""
    if text is None:
        return None
    parts, at = [], 0
    for start, less, kind in sorted((a, -b, kind) for kind in KINDS for a, b in spans[kind]):
        if start >= at:
            parts += [text[at:start], f"[{kind}]"]
            at = -less
        else:
            at = max(at, -less)
    return "".join([*parts, text[at:]])


def find_pii(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, and redacted text on demand, a row of `docs` each.

    One pass over the texts, no shuffle. Null and empty texts have no spans (base_sha256 is that of no bytes); repeated
    rows stay; null ids stay; an empty table gives an empty one; other columns are not read.
    """
    names = ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_spans", *["redacted"] * with_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find_spans(x.as_py()) for x in batch.column(1)]
            columns = [batch.column(0), *(pa.array([len(s[k]) for s in found], pa.int64()) for k in BASE_KINDS)]
            columns.append(pa.array([hashlib.sha256(render(s, BASE_KINDS).encode()).hexdigest() for s in found], pa.string()))
            columns.append(pa.array([render(s, KINDS) for s in found], pa.string()))
            columns.append(pa.array([sum(map(len, s.values())) for s in found], pa.int64()))
            if with_text:
                columns.append(pa.array([redact(x.as_py(), s) for x, s in zip(batch.column(1), found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long" + ", redacted string" * with_text
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, kind)
