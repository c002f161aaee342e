"""Secrets by a keyword prefilter, anchored patterns near its hits, and embedded checks.

One Aho-Corasick pass over the lower-cased text finds keywords and the fixed
beginnings of tokens.  Only at such hits is a pattern tried, anchored there.
Tokens that carry a check value are then validated by it, so that look-alikes
stay.  Runs of hexadecimal digits have no keyword; one linear scan finds them.

Base kinds, by fixed patterns: ``assign`` (a value after "password=" and the
like), ``access`` (an access-key id) and ``hex`` (24 digits or more).  Kinds
that the method adds:

* ``crc``: a token ``ghp_``, ``gho_``, ``ghu_``, ``ghs_``, ``ghr_`` or ``npm_``
  with 36 letters and digits, the last six being the CRC-32 of the others in
  base 62;
* ``wallet``: an extended private key (``xprv``) or, behind a cue word, a
  private key for import, both in base 58 with a double SHA-256 check;
* ``jwt``: a signed token whose header is JSON with an algorithm;
* ``pem``: a private-key block whose length field agrees with its bytes;
* ``vendor``: a token of a fixed shape, for which no check is published.

Spans are code points, the end exclusive.  Patterns have no length bound, and
the scan is linear: a hit within a span of its kind is part of that span.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.llm.common import text_or_empty

BASE = ("assign", "access", "hex")
ADDED = ("crc", "wallet", "jwt", "pem", "vendor")
#: Keywords, and the beginnings that tokens of a kind have.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CRC_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
WALLET_CUES = ("private key", "private_key", "privkey", "wif", "wallet")
VENDOR_PREFIXES = ("aiza", "xoxb-", "xoxp-", "xoxa-", "sk_live_", "rk_live_", "glpat-")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"

_ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_CRC = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
_XPRV = re.compile(rf"xprv[{BASE58}]{{107}}(?![A-Za-z0-9])")
_WIF = re.compile(rf"[\"']?\s{{0,2}}[:=]?\s{{0,2}}[\"']?([5KL][{BASE58}]{{50,51}})(?![A-Za-z0-9])")
_JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----")
_END = re.compile(r"-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----")
_VENDOR = re.compile(r"AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])|xox[abp]-[0-9]+-[A-Za-z0-9-]+|[sr]k_live_[A-Za-z0-9]{24,}|glpat-[A-Za-z0-9_-]{20,}")
_LOWER = {c: c + 32 for c in range(65, 91)}
_AUTOMATON = []


def base62_crc(body: str) -> str:
    n, out = zlib.crc32(body.encode()), ""
    while n or len(out) < 6:
        n, at = divmod(n, 62)
        out = BASE62[at] + out
    return out


def base58_valid(token: str) -> bool:
    """Whether the last four of the bytes that ``token`` stands for begin the others' double SHA-256."""
    n = 0
    for c in token:
        n = n * 58 + BASE58.index(c)
    raw = bytes(len(token) - len(token.lstrip("1"))) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return len(raw) > 4 and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def jwt_header(part: str) -> bool:
    """Whether ``part`` is an object with an algorithm, in base 64."""
    try:
        head = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (binascii.Error, UnicodeDecodeError, ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def der_length(body: str) -> bool:
    """Whether the bytes of a block are one sequence whose length field counts all that follow it."""
    lines = [x for x in body.split("\n") if ":" not in x]
    try:
        raw = base64.b64decode("".join("".join(lines).split()), validate=True)
    except (binascii.Error, ValueError):
        return False
    if raw.startswith(b"openssh-key-v1\0"):
        return True
    if len(raw) < 4 or raw[0] != 0x30:
        return False
    if raw[1] < 0x80:
        return raw[1] == len(raw) - 2
    more = raw[1] & 0x7F
    return 0 < more <= 8 and int.from_bytes(raw[2:2 + more], "big") == len(raw) - 2 - more


def _automaton():
    import ahocorasick
    a = ahocorasick.Automaton()
    for words, kind in ((ASSIGN_WORDS, "assign"), (("akia",), "access"), (CRC_PREFIXES, "crc"), (("xprv",), "xprv"), (WALLET_CUES, "wif"),
                        (("eyj",), "jwt"), (("-----begin ",), "begin"), (("-----end ",), "end"), (VENDOR_PREFIXES, "vendor")):
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def _anchored(pattern: re.Pattern, text: str, starts: list[int]) -> Iterator[re.Match]:
    """Leftmost matches that begin at a hit and do not overlap."""
    free = 0
    for at in starts:
        if at >= free and (m := pattern.match(text, at)):
            yield m
            free = m.end()


def _blocks(text: str, begins: list[int], ends: list[int]) -> Iterator[tuple[int, int]]:
    """Key blocks: from each beginning to the first end behind it, if no other block begins in between."""
    begun = [m for at in begins if (m := _BEGIN.match(text, at))]
    ended = [m for at in ends if (m := _END.match(text, at))]
    stops = [m.start() for m in ended]
    for m, following in zip_longest(begun, begun[1:]):
        after = following.start() if following else len(text)
        i = bisect_left(stops, m.end())
        if i < len(ended) and stops[i] < after and der_length(text[m.end():stops[i]]):
            yield m.start(), ended[i].end()


def spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """All spans by kind, each kind in order of start and without overlap."""
    if not _AUTOMATON:
        _AUTOMATON.append(_automaton())
    hits: dict[str, list[int]] = {}
    for end, (kind, n) in _AUTOMATON[0].iter(text.lower() if text.isascii() else text.translate(_LOWER)):
        hits.setdefault(kind, []).append(end + 1 - n)
    at = lambda kind: hits.get(kind, [])
    # A word character or a hyphen before a token makes it the middle of something else; so no two scans read one run.
    own = lambda kind: [a for a in at(kind) if not (a and (text[a - 1].isalnum() or text[a - 1] in "_-"))]
    out = {
        "assign": [m.span() for m in _anchored(_ASSIGN, text, at("assign")) if m.end(1) - m.start(1) >= 6],
        "access": [m.span() for m in _anchored(_ACCESS, text, at("access")) if m.end() - m.start() >= 20],
        "hex": [m.span() for m in _HEX.finditer(text)],
        "crc": [m.span() for m in _anchored(_CRC, text, own("crc")) if base62_crc(m.group(1)[:30]) == m.group(1)[30:]],
        "jwt": [m.span() for m in _anchored(_JWT, text, own("jwt")) if jwt_header(m.group(1))],
        "pem": list(_blocks(text, at("begin"), at("end"))),
        "vendor": [m.span() for m in _anchored(_VENDOR, text, own("vendor"))],
    }
    wallets = [m.span() for m in _anchored(_XPRV, text, own("xprv")) if base58_valid(m.group())]
    cues = [a + len(w) for a in own("wif") for w in WALLET_CUES if text[a:a + len(w)].translate(_LOWER) == w]
    wallets += [m.span(1) for a in cues if (m := _WIF.match(text, a)) and base58_valid(m.group(1))]
    out["wallet"] = sorted(set(wallets))
    return out


def joined(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    """``kind:start:end`` by start, then kind as listed."""
    rows = sorted((a, i, b) for i, k in enumerate(kinds) for a, b in found[k])
    return ",".join(f"{kinds[i]}:{a}:{b}" for a, i, b in rows)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_added long, base string, spans string"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1):
            found = spans(text.as_py())
            rows.append((*(len(found[k]) for k in BASE), sum(len(found[k]) for k in ADDED), joined(found, BASE), joined(found, BASE + ADDED)))
        cols = zip(*rows, strict=True) if rows else [[]] * 6
        types = [pa.int64()] * 4 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
                                         ["doc_id", "n_assign", "n_access", "n_hex", "n_added", "base", "spans"])


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``doc_id``, the counts of the base kinds and of the added ones together, ``base`` and ``spans``
    (``kind:start:end`` by start, then kind, joined by commas).

    Texts are read whole.  A null text counts as empty; a null id stays null; repeated rows give a row each; spans
    that start together are told apart by kind; other columns are ignored, whatever they are called; an empty table
    gives no rows.  A map without a shuffle: a lost task is run again by itself.
    """
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(_find, SCHEMA)


def redacted(text: str, mark: str = "<secret>") -> str:
    """``text`` with each stretch that spans cover, overlapping ones together, replaced by ``mark``."""
    out, at, held = [], 0, None
    for a, b in sorted(s for v in spans(text).values() for s in v):
        if held and a < held[1]:
            held = (held[0], max(held[1], b))
            continue
        if held:
            out += [text[at:held[0]], mark]
            at = held[1]
        held = (a, b)
    if held:
        out += [text[at:held[0]], mark]
        at = held[1]
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", mark: str = "<secret>") -> DataFrame:
    """``docs`` with its secrets replaced by ``mark``; null texts stay null, all other columns stay as they are."""
    field = docs.schema.names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [None if t.as_py() is None else redacted(t.as_py(), mark) for t in batch.column(field)]
            yield batch.set_column(field, batch.schema.field(field), pa.array(clean, batch.schema.field(field).type))
    return docs.mapInArrow(run, docs.schema)
