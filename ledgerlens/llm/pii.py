"""Personal data: patterns propose spans, checksums confirm them, context words adjust their scores.

Base kinds (email, ip, card, phone) always stay once their check passes. Further kinds
are proposed by looser patterns and kept if their score reaches ``KEEP``: the score
starts from the pattern's own, a passed checksum adds, a failed one rules out, and a
word of the kind's context near the span adds. Patterns are written so that time stays
linear in the length of a text. Offsets are code points, ends exclusive.

A null text counts as empty and has no spans (the row stays, a null text stays null
when redacted). Repeated rows, null ids and extra columns are carried as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import map_rows

BASE = ("email", "ip", "card", "phone")
KEEP, CONFIRMED, NEARBY, REACH = 0.6, 0.5, 0.35, 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_WORD = re.compile(r"[^\W_]+")

#: Two-letter country codes and lengths of their bank account numbers.
IBAN_LENGTHS = {"AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
                "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27,
                "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20,
                "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29,
                "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24,
                "XK": 20}
#: length -> its account numbers, single spaces allowed
_ACCOUNT = {n: re.compile(rf"[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in {*IBAN_LENGTHS.values()}}
#: kind -> (pattern, score of the pattern alone, context words)
MORE = {
    "iban": (re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])"), 0.3,
             {"iban", "account", "bank", "konto", "cuenta", "compte"}),
    "national_id": (re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), 0.3, {"ssn", "social", "security", "tax", "id"}),
    "local_phone": (re.compile(r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"), 0.3,
                    {"phone", "tel", "telephone", "call", "mobile", "telefon", "teléfono", "fax"}),
    "access_key": (re.compile(r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"), 0.7, {"key", "aws", "access"}),
    "secret": (re.compile(r"(?<![A-Za-z0-9])(?:password|passwd|api_key|secret)=[^\s]{8,}"), 0.7, set()),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The check of international bank account numbers: moved to the front, letters as 10 to 35, the remainder is 1."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from each @ so that time is linear."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind as listed, then start; matches that fail their check are consumed and dropped."""
    out = [("email", *s) for s in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def accounts(text: str) -> Iterator[re.Match]:
    """Bank account numbers by their country's length, so that a word in capitals behind one isn't taken for its end; a number doesn't overlap the one before."""
    free = 0
    for head in MORE["iban"][0].finditer(text):
        pattern = _ACCOUNT.get(IBAN_LENGTHS.get(head[0][:2]))
        m = pattern.match(text, head.start()) if pattern and head.start() >= free else None
        if m and mod97(m[0].replace(" ", "")):
            free = m.end()
            yield m


def more_spans(text: str) -> list[tuple[str, int, int, float]]:
    """Spans of the further kinds with their scores, those below ``KEEP`` left out."""
    out = []
    for kind, (pattern, score, context) in MORE.items():
        for m in accounts(text) if kind == "iban" else pattern.finditer(text):
            s = score + CONFIRMED * (kind == "iban")  # an account's check has passed
            near = text[max(0, m.start() - REACH):m.start()] + " " + text[m.end():m.end() + REACH]
            if context and not context.isdisjoint(w.lower() for w in _WORD.findall(near)):
                s += NEARBY
            if s >= KEEP:
                out.append((kind, m.start(), m.end(), min(1.0, s)))
    return out


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Replaces each span by its kind in angle brackets; of overlapping spans the first, longest one names the whole stretch."""
    out, free = [], 0
    merged: list[list] = []
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    for kind, start, end in merged:
        out += [text[free:start], f"<{kind.upper()}>"]
        free = end
    return "".join([*out, text[free:]])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores) for every row; counts and hash are of the base spans."""
    def find(i, text):
        base = base_spans(text or "")
        more = more_spans(text or "")
        counts = [sum(s[0] == kind for s in base) for kind in BASE]
        spans = base + [s[:3] for s in more]
        return [(i, *counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), [1.0] * len(base) + [s[3] for s in more])]

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), lambda: find,
                    f"id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, scores array<double>")


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs``) and ``clean``, its text with personal data replaced."""
    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else redact(t, base_spans(t) + [s[:3] for s in more_spans(t)]))

    return docs.select(F.struct("*").alias("row"), clean(F.col(text_col)).alias("clean"))
