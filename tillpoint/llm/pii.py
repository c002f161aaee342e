"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over the text: at-signs and
their spelled-out forms, plus signs, schemes, and words that announce an
identifier.  Around each anchor a small deterministic parser expands to the
span's edges and validates it.  Addresses in digits need no anchor word, so
runs of digits are anchors too.

Kinds found without a cue, by fixed patterns (the base): ``email``, ``ip``,
``card`` and ``phone``.  Kinds that the method adds: ``account`` (an IBAN with
valid check digits, or the number after a word such as "account" or
"passport"), ``secret`` (the value after "password=", "token =" and the like),
``spelled`` (an address written with "(at)" and "(dot)") and ``url`` (a link
whose authority holds a user or whose query names a person's data).

Spans are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.llm.common import text_or_empty

BASE = ("email", "ip", "card", "phone")
ADDED = ("account", "secret", "spelled", "url")
#: The words that announce an identifier, in the languages of the corpus.
ACCOUNT_CUES = ("account", "acct", "iban", "konto", "kontonummer", "cuenta", "compte", "passport", "passnummer", "pasaporte", "passeport",
                "ssn", "social security", "dni", "nif", "steuernummer", "national id", "customer id", "patient id", "licence no", "license no")
SECRET_CUES = ("password", "passwd", "passwort", "secret", "api_key", "apikey", "api key", "access_key", "token", "auth_token", "pwd")
SPELLED_AT = ("[at]", "(at)", "{at}", " at ")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "mailto:")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# From the first digit of a run on, each run taken once: a long run of digits is no square of work.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"(?:\s?(?:no|nr|number|num|id)\b\.?)?\s{0,2}[:#=]?\s{0,2}([A-Za-z]{0,4}[0-9][A-Za-z0-9]*(?:[\x20./-]?[A-Za-z0-9]*[0-9][A-Za-z0-9]*)*)", re.I)
_HEAD = re.compile(r"\s{0,2}[:=]\s{0,2}[\"']?")
# A value ends at white space or a quote; commas and semicolons within it are part of it, at its end they are not.
_VALUE = re.compile(_HEAD.pattern + r"([^\s\"']{5,}[^\s\"',;])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SPELLED_HOST = re.compile(r"\s?[A-Za-z0-9-]+(?:\s?(?:\[dot\]|\(dot\)|\{dot\}|\sdot\s)\s?[A-Za-z0-9-]+|\.[A-Za-z0-9-]+)+")
_URL = re.compile(r"[^\s<>\"]+")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def iban(text: str) -> bool:
    s = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str, ats: list[int]) -> list[tuple[int, int]]:
    """Leftmost addresses that do not overlap: the local part grows left from the at-sign, not into the span before."""
    out, free = [], 0
    for at in ats:
        if at < free:
            continue
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
    return out


def base(text: str, ats: list[int], pluses: bool) -> dict[str, list[tuple[int, int]]]:
    cards = [m for m in _CARD.finditer(text) if m.end() - m.start() >= 16]
    bare = lambda m: m.group().replace(" ", "").replace("-", "")
    digits = lambda m: sum("0" <= c <= "9" for c in m.group())
    return {
        "email": emails(text, ats),
        "ip": [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))],
        "card": [m.span() for m in cards if 16 <= len(bare(m)) <= 19 and luhn(bare(m))],
        "phone": [m.span() for m in _PHONE.finditer(text) if 8 <= digits(m) <= 15] if pluses else [],
    }


def local_part(text: str, at: int, free: int) -> int | None:
    """Where the local part before a spelled-out at-sign begins (not before ``free``): a letter or digit; one space may lie between."""
    end = at - 1 if at > free and text[at - 1].isspace() else at
    start = end
    while start > free and text[start - 1] in _LOCAL:
        start -= 1
    while start < end and text[start] in "._%+-":
        start += 1
    return start if start < end else None


def _automaton():
    import ahocorasick
    a = ahocorasick.Automaton()
    for words, kind in ((("@",), "at"), (("+",), "plus"), (SPELLED_AT, "spelled"), (SCHEMES, "url"), (ACCOUNT_CUES, "account"), (SECRET_CUES, "secret")):
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


_AUTOMATON = []


def lowered(text: str) -> str:
    """ASCII lower case, so that places stay the same."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """All spans by kind, each kind in order of start and without overlap."""
    if not _AUTOMATON:
        _AUTOMATON.append(_automaton())
    anchors: dict[str, list[tuple[int, int]]] = {}
    for end, (kind, n) in _AUTOMATON[0].iter(lowered(text)):
        anchors.setdefault(kind, []).append((end + 1 - n, end + 1))
    out = base(text, [a for a, _ in anchors.get("at", ())], "plus" in anchors)
    more: dict[str, list[tuple[int, int]]] = {k: [] for k in ADDED}
    # A cue within a span is part of it, for every kind, so that no code point is read again and again.
    free = 0
    for a, b in anchors.get("account", ()):
        if a < free or (a and text[a - 1].isalnum()) or text[b:b + 1].isalpha():
            continue
        if m := _NUMBER.match(text, b):
            free = m.end()
            if sum("0" <= c <= "9" for c in m.group(1)) >= 6:
                more["account"].append(m.span(1))
    if any("A" <= c <= "Z" for c in text):
        more["account"] += [m.span() for m in _IBAN.finditer(text) if iban(m.group())]
    # A value ends by itself; one that would begin within another is part of it, so each code point is read once.
    free = 0
    for a, b in anchors.get("secret", ()):
        if (a and text[a - 1].isalnum()) or not (head := _HEAD.match(text, b)) or head.end() < free:
            continue
        if m := _VALUE.match(text, b):
            more["secret"].append(m.span(1))
            free = m.end()
    free = 0
    for a, b in anchors.get("spelled", ()):
        if a < free or not (host := _SPELLED_HOST.match(text, b)):
            continue
        # " at " is a word of prose: it needs a spelled-out dot as well.
        if text[a] == " " and "dot" not in host.group().lower():
            free = host.end()
            continue
        start = local_part(text, a, free)
        if start is not None:
            more["spelled"].append((start, host.end()))
            free = host.end()
    free = 0
    for a, b in anchors.get("url", ()):
        if a < free or not (m := _URL.match(text, b)):
            continue
        free = m.end()
        if ("@" in m.group() or re.search(r"[?&](?:user|name|email|phone|token|password|session)[a-z_]*=", m.group(), re.I)):
            more["url"].append((a, m.end()))
    for kind, found in more.items():
        kept, free = [], -1
        for s in sorted(set(found), key=lambda s: (s[0], -s[1])):
            if s[0] >= free:
                kept.append(s)
                free = s[1]
        out[kind] = kept
    return out


def joined(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


SCHEMA = "doc_id long, base string, spans string, n_email long, n_ip long, n_card long, n_phone long, n_added long"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1):
            found = spans(text.as_py())
            rows.append((joined(found, BASE), joined(found, BASE + ADDED), *(len(found[k]) for k in BASE), sum(len(found[k]) for k in ADDED)))
        cols = zip(*rows, strict=True) if rows else [[]] * 7
        types = [pa.string(), pa.string(), *[pa.int64()] * 5]
        names = ["base", "spans", "n_email", "n_ip", "n_card", "n_phone", "n_added"]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", *names])


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``doc_id``, ``base`` and ``spans`` (``kind:start:end`` joined by commas, by
    kind and start) and the counts by kind.  A null text counts as empty; a null id stays null;
    repeated rows give a row each; other columns are ignored; an empty table gives no rows.
    """
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(_find, SCHEMA)


def masked(text: str) -> str:
    """``text`` with each span replaced by its kind in angle brackets; of overlapping spans the first, then the longest, counts."""
    out, at = [], 0
    for a, b, k in sorted(((a, b, k) for k, v in spans(text).items() for a, b in v), key=lambda s: (s[0], -s[1])):
        if a >= at:
            out += [text[at:a], f"<{k}>"]
            at = b
    return "".join([*out, text[at:]])
