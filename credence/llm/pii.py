"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Base kinds are ``email``, ``ip``, ``card`` (Luhn) and ``phone``. The method adds ``iban`` spans
(account numbers of their country's length, confirmed by mod-97) and a score for each span: a prior of its kind, raised by words
nearby that name such data and lowered by words that name something else. Base spans stay whatever
their score; added spans are kept from ``KEEP`` on.

Defined results: a null text counts as empty and has no spans. Rows are independent, so repeated
rows, ties and null ids pass through. Texts of any length are scanned whole, in linear time.
Columns other than id and text, whatever their names, are not read.
"""

from __future__ import annotations

import re
from hashlib import sha256

from pyspark.sql import DataFrame

from credence.llm.common import map_rows

KINDS = ("email", "ip", "card", "phone")
KEEP = 0.5
#: Characters before and after a span in which context words count.
NEARBY = 48
#: Prior score, words that raise it, words that lower it.
CONTEXT = {
    "email": (0.9, ("mail", "contact", "write", "address"), ("example",)),
    "ip": (0.6, ("ip", "host", "server", "address", "login"), ("version", "release", "section", "chapter")),
    "card": (0.7, ("card", "visa", "credit", "debit", "payment", "amex"), ("isbn", "serial", "order", "tracking")),
    "phone": (0.6, ("phone", "tel", "call", "mobile", "fax", "contact"), ("score", "version", "serial")),
    "iban": (0.7, ("iban", "bank", "account", "konto", "transfer", "bic"), ("serial", "part", "license")),
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9]{4})")
_IBAN_GROUP = re.compile(r"\x20?[A-Z0-9]{4}")
_IBAN_TAIL = re.compile(r"\x20?[A-Z0-9]{1,3}(?![A-Za-z0-9])")
_ALNUM = re.compile(r"[A-Za-z0-9]")
#: Characters of an account number by country code, as registered.
IBAN_LENGTHS = {
    code: n
    for n, codes in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for code in codes.split()
}
_WORD = re.compile(r"[a-z]+")
_DIGITS = {ord(c): None for c in " ()-.+"}
_DOUBLE = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(_DOUBLE[int(c)] for c in digits[-2::-2])
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _ibans(text: str) -> list[tuple[int, int]]:
    """Account numbers in groups of four, with or without spaces between: of the length of their
    country; where the country is none of the registered ones, the longest end that mod-97 confirms."""
    out, last = [], 0
    for m in _IBAN_HEAD.finditer(text):
        a, at = m.span()
        if a < last:
            continue
        size = IBAN_LENGTHS.get(text[a : a + 2])
        ends = []
        for n in range(8, 36, 4):  # characters after the group
            if (tail := _IBAN_TAIL.match(text, at)) and n > 12:
                ends.append(tail.end())
            group = _IBAN_GROUP.match(text, at)
            if not group:
                break
            at = group.end()
            if n >= 12 and not _ALNUM.match(text, at):
                ends.append(at)
        else:
            if tail := _IBAN_TAIL.match(text, at):
                ends.append(tail.end())
        for b in reversed(ends):
            number = text[a:b].replace(" ", "")
            if size in (None, len(number)) and mod97(number):
                out.append((a, b))
                last = b
                break
    return out


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches found from each ``@``: the local part reaches back over its characters, no
    further than the match before."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > last and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start():
            digits = m[0].translate(_DIGITS)
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base matches, by kind as listed and then by start."""
    out = [("email", *s) for s in _emails(text)] if "@" in text else []
    if "." in text:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    out += [("card", *s) for s in _cards(text)]
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(m[0].translate(_DIGITS)) <= 15]
    return out


def score(text: str, kind: str, a: int, b: int) -> float:
    prior, up, down = CONTEXT[kind]
    words = set(_WORD.findall(text[max(0, a - NEARBY) : a].lower())) | set(_WORD.findall(text[b : b + NEARBY].lower()))
    if kind == "email":
        words |= set(_WORD.findall(text[a:b].rpartition("@")[2].lower()))
    return round(min(1.0, max(0.0, prior + 0.25 * any(w in words for w in up) - 0.3 * any(w in words for w in down))), 3)


def scored_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """All spans with their scores, base kinds first."""
    text = text or ""
    out = [(k, a, b, score(text, k, a, b)) for k, a, b in base_spans(text)]
    for a, b in _ibans(text):
        if (s := score(text, "iban", a, b)) >= KEEP:
            out.append(("iban", a, b, s))
    return out


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its spans as an array of structs."""
    schema = "doc_id long, spans array<struct<kind:string,start:int,end:int,score:double>>"
    names = ("kind", "start", "end", "score")

    def rows(ids, texts):
        return [(i, [dict(zip(names, s, strict=True)) for s in scored_spans(t)]) for i, t in zip(ids, texts, strict=True)]

    return map_rows(docs, [id_col, text_col], schema, rows)


def op2(docs: DataFrame) -> DataFrame:
    def rows(ids, texts):
        out = []
        for i, t in zip(ids, texts, strict=True):
            spans = scored_spans(t)
            n = {k: 0 for k in (*KINDS, "iban")}
            for s in spans:
                n[s[0]] += 1
            said = [f"{k}:{a}:{b}" for k, a, b, _ in spans]
            base = ",".join(x for x, s in zip(said, spans, strict=True) if s[0] != "iban")
            top = max((s[3] for s in spans), default=0.0)
            scores = ",".join(str(s[3]) for s in spans)
            out.append((i, *(n[k] for k in KINDS), sha256(base.encode()).hexdigest(), ",".join(said), n["iban"], top, scores))
        return out

    schema = (
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
        "n_iban long, max_score double, scores string"
    )
    return map_rows(docs, ["doc_id", "text"], schema, rows)
