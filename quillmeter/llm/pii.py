"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass: at-signs, plus signs, scheme separators, identifier cues and
digits. Deterministic local parsers expand each anchor to the boundaries of an address, number or account and
validate it. Four base kinds follow fixed patterns exactly (leftmost, non-overlapping per kind, failing matches
dropped without retries); further kinds are added by cues.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Callable

import ahocorasick
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmeter.llm.common import with_text_columns

Span = tuple[int, int, str]

#: Base kinds in the order of ties, then the kinds that the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account", "secret")
ORDER = {k: i for i, k in enumerate(KINDS)}

DIGITS = frozenset(string.digits)
ALNUM = frozenset(string.ascii_letters + string.digits)
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
SCHEME = ALNUM | frozenset("+.-")
URL_END = frozenset(" \t\n\x0b\x0c\r<>\"'`{}|\\^")
ACCOUNT = frozenset(string.ascii_uppercase + string.digits)
SECRET = ALNUM | frozenset("_-+/=")

#: Fixed cue words: an identifier follows them.
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "compte", "cuenta", "passport", "ssn")
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "api key", "access_key")
#: Fixed lengths of international bank account numbers by country.
IBAN_LENGTHS = {
    "AD": 24, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18,
    "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21,
    "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27,
}
DATE = re.compile(r"[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4}")


def anchors() -> ahocorasick.Automaton:
    """Anchor strings and what they announce: their first and last letters tell upper and lower case apart."""
    found = ahocorasick.Automaton()
    for word, kind in (("@", "at"), ("+", "plus"), ("://", "scheme")):
        found.add_word(word, (kind, len(word)))
    for d in string.digits:
        found.add_word(d, ("digit", 1))
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            parts = [w for w in re.split("[_ ]", cue)]
            glued = {sep.join(w.capitalize() for w in parts) for sep in ("", "_", " ", "-")} if len(parts) > 1 else set()
            for word in {cue, cue.upper(), cue.capitalize()} | glued:
                found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d)
        if i % 2:
            v = 2 * v - 9 if v > 4 else 2 * v
        total += v
    return total % 10 == 0


def _run(text: str, at: int, allowed: frozenset[str]) -> int:
    end, n = at, len(text)
    while end < n and text[end] in allowed:
        end += 1
    return end


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign; the part before it may not reach below ``floor``."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    if start == at:
        return None
    end = _run(text, at + 1, LABEL)
    if end == at + 1:
        return None
    dots = 0
    while end < len(text) and text[end] == "." and (more := _run(text, end + 1, LABEL)) > end + 1:
        end, dots = more, dots + 1
    return (start, end) if dots else None


def _numbers(text: str, runs: list[tuple[int, int]]) -> list[Span]:
    """Addresses and cards from the maximal runs of digits, in order."""
    out: list[Span] = []
    # dotted quads: chains of runs joined by single dots, cut into consecutive fours
    i = 0
    while i < len(runs):
        j = i
        while j + 1 < len(runs) and runs[j + 1][0] == runs[j][1] + 1 and text[runs[j][1]] == ".":
            j += 1
        for k in range(i, j - 2, 4):
            parts = [text[a:b].lstrip("0") for a, b in runs[k : k + 4]]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                out.append((runs[k][0], runs[k + 3][1], "ip"))
        i = j + 1
    # cards: chains of runs joined by single blanks or hyphens
    i = 0
    while i < len(runs):
        j = i
        while j + 1 < len(runs) and runs[j + 1][0] == runs[j][1] + 1 and text[runs[j][1]] in " -":
            j += 1
        if 14 <= sum(b - a for a, b in runs[i : j + 1]) <= 19:
            start, end = runs[i][0], runs[j][1]
            if luhn("".join(text[a:b] for a, b in runs[i : j + 1])):
                out.append((start, end, "card"))
        i = j + 1
    return out


def _phone(text: str, at: int) -> tuple[int, int] | None:
    """The number behind a plus sign: the longest run of its characters, back to the last digit."""
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return None
    end = _run(text, at + 2, PHONE)
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    return (at, end) if end > at + 3 else None


def _url(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = at
    while start > floor and text[start - 1] in SCHEME:
        start -= 1
    while start < at and not text[start].isalpha():
        start += 1
    if start == at:
        return None
    end, n = at + 3, len(text)
    while end < n and text[end] not in URL_END:
        end += 1
    while end > at + 3 and text[end - 1] in ".,;:!?)]#$%&*":
        end -= 1
    return (start, end) if end > at + 3 else None


def _after_cue(text: str, at: int) -> int:
    """Where the value behind a cue begins: blanks, a separator and an opening quote are skipped."""
    n = len(text)
    for allowed in (" \t", ":=#", " \t", "\"'"):
        while at < n and text[at] in allowed:
            at += 1
    return at


def _cued(text: str, kind: str, start: int, end: int) -> tuple[int, int] | None:
    if start and (text[start - 1].isalnum()) or end < len(text) and text[end].isalnum():
        return None
    a = _after_cue(text, end)
    if kind == "secret":
        b = _run(text, a, SECRET)
        return (a, b) if b - a >= 16 and not DIGITS.isdisjoint(text[a:b]) else None
    if span := _iban(text, a):
        return span
    if DATE.match(text, a):
        return None
    b = a
    while b < len(text) and (text[b] in ACCOUNT or text[b] in " -" and b + 1 < len(text) and text[b + 1] in DIGITS):
        b += 1
    digits = sum(c in DIGITS for c in text[a:b])
    return (a, b) if 8 <= digits <= 34 and b - a <= 48 else None


def iban_ok(letters: str) -> bool:
    """Country and check digits first; behind the rest, with letters as 10 to 35, they leave 1 modulo 97."""
    turned = letters[4:] + letters[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _iban(text: str, at: int) -> tuple[int, int] | None:
    """A bank account number in groups parted by single blanks, of its country's length and with right check digits.

    Of a country without a known length, the longest number of 15 to 34 letters and digits that ends with a group counts.
    """
    if not (re.fullmatch("[A-Za-z]{2}[0-9]{2}", text[at : at + 4])):
        return None
    length = IBAN_LENGTHS.get(text[at : at + 2].upper())
    letters, b, best = "", at, None
    while b < len(text) and len(letters) < (length or 34):
        if text[b] in ALNUM:
            letters += text[b].upper()
        elif text[b] != " " or text[b - 1] == " ":
            break
        b += 1
        if text[b - 1] in ALNUM and (b == len(text) or text[b] not in ALNUM) and (len(letters) == length if length else len(letters) >= 15) and iban_ok(letters):
            best = (at, b)
    return best


def find(text: str, automaton: ahocorasick.Automaton) -> list[Span]:
    """All spans (start, end, kind) by start, then kind; code points, end exclusive."""
    out: list[Span] = []
    ends = dict.fromkeys(KINDS, 0)
    runs: list[tuple[int, int]] = []
    digit_end = 0

    def keep(kind: str, span: tuple[int, int] | None) -> None:
        if span and span[0] >= ends[kind]:
            out.append((*span, kind))
            ends[kind] = span[1]

    for last, (what, length) in automaton.iter(text):
        at = last - length + 1
        if what == "digit":
            if at >= digit_end:
                digit_end = _run(text, at, DIGITS)
                runs.append((at, digit_end))
        elif what == "at":
            keep("email", _email(text, at, ends["email"]))
        elif what == "plus":
            if at >= ends["phone"] and (span := _phone(text, at)):
                ends["phone"] = span[1]  # a failing match is dropped but not retried
                if 10 <= sum(c in DIGITS for c in text[span[0] : span[1]]) <= 15:
                    out.append((*span, "phone"))
        elif what == "scheme":
            keep("url", _url(text, at, ends["url"]))
        else:
            keep(what, _cued(text, what, at, last + 1))
    out += _numbers(text, runs)
    out.sort(key=lambda s: (s[0], ORDER[s[2]], s[1]))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += (text[at:a], f"[{kind.upper()}]")
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``spans`` (array of start, end, kind) and ``redacted``; null texts count as empty and have no span.

    One pass without a shuffle; the parsers look only around their anchors, so a text takes linear time.
    """

    def make() -> Callable[[list[str]], list]:
        automaton = anchors()

        def apply(texts: list[str]) -> list:
            found = [find(t, automaton) for t in texts]
            return [
                [[{"start": a, "end": b, "kind": k} for a, b, k in s] for s in found],
                [redacted(t, s) if s else t for t, s in zip(texts, found, strict=True)],
            ]

        return apply

    new = {"spans": "array<struct<start:int,end:int,kind:string>>", "redacted": "string"}
    return with_text_columns(docs, text, make, new, keep)


def count_of(kind: str, spans: str = "spans") -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def digest(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document: counts of the base kinds, a digest of the base spans, and all spans as text."""

    def make() -> Callable[[list[str]], list]:
        automaton = anchors()

        def apply(texts: list[str]) -> list:
            found = [find(t, automaton) for t in texts]
            base = [[s for s in spans if s[2] in BASE_KINDS] for spans in found]
            counts = [[sum(s[2] == k for s in spans) for spans in base] for k in BASE_KINDS]
            return [
                *counts,
                [hashlib.sha256(joined(s).encode()).hexdigest() for s in base],
                [joined(s) for s in found],
            ]

        return apply

    new = {f"n_{k}": "long" for k in BASE_KINDS} | {"base_sha256": "string", "spans": "string"}
    return with_text_columns(docs, text, make, new, [doc_id])
