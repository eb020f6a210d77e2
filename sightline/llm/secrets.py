"""Secret scans: keyword prefilter, anchored patterns near hits, checksums.

An Aho-Corasick automaton over the lower-cased bytes finds keywords; only there
are patterns matched, anchored at the hit. Runs of hexadecimal digits have no
keyword; their prefilter is a table translation and one substring search. Kinds
whose tokens embed a checksum or an encoded header are kept only if it holds.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import re
import zlib

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import arrow_map, raw_texts

#: Kinds in the order in which they are listed; the first three are the base.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "github", "npm", "jwt", "pem")

_ASSIGN = re.compile(rb"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")
_GITHUB = re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
_NPM = re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
_JWT = re.compile(rb"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
# A private key from its BEGIN line over headers and base64 to its END line, or, if
# that is missing, to the end of the base64; line breaks may be escaped or quoted.
_GAP = rb"""(?:[\s>#*|"',;]|\\+[nrt])"""
_HEADERS = rb"(?:" + _GAP + rb"*+[A-Za-z][A-Za-z0-9-]*+:[^\r\n\\]*+(?=[\r\n\\]))*+"
_WHOLE = _HEADERS + rb"(?:[A-Za-z0-9+/=]|" + _GAP + rb")*+-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----"
_OPEN = _HEADERS + rb"(?:" + _GAP + rb"++[A-Za-z0-9+/]{24,}+={0,2})++(?:" + _GAP + rb"++(?:(?=[A-Za-z]*[0-9+/=])[A-Za-z0-9+/=]++|[A-Za-z]++(?=\s*(?:[\r\n\\\"']|\Z))))?+"
_PEM = re.compile(rb"-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----(?:" + _WHOLE + rb"|" + _OPEN + rb")?")
#: Keyword, kind and pattern; a keyword starts the pattern's match.
_RULES = [(k, "assign", _ASSIGN) for k in ("password", "passwd", "secret", "token", "api_key", "apikey")] + [("akia", "access", _ACCESS)] + [(f"gh{c}_", "github", _GITHUB) for c in "pousr"] + [("npm_", "npm", _NPM), ("eyj", "jwt", _JWT), ("-----begin ", "pem", _PEM)]
_HEX_DIGITS = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


@functools.lru_cache(maxsize=1)
def _automaton():
    found = ahocorasick.Automaton()
    for keyword, kind, pattern in _RULES:
        found.add_word(keyword, (len(keyword), kind, pattern))
    found.make_automaton()
    return found


def base62_crc(body: bytes) -> bytes:
    """CRC-32 as six base-62 digits, as such tokens end with."""
    n, out = zlib.crc32(body), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = _DIGITS[r] + out
    return out.encode()


def _checked(kind: str, match: re.Match) -> bool:
    got = match[0]
    if kind == "assign":
        return len(match[1]) >= 6
    if kind == "access":
        return len(got) >= 20
    if kind in ("github", "npm"):
        return base62_crc(got[4:-6]) == got[-6:]
    if kind == "jwt":
        head = got.split(b".")[0]
        try:
            return "alg" in json.loads(base64.urlsafe_b64decode(head + b"=" * (-len(head) % 4)))
        except (ValueError, TypeError):
            return False
    return True


def scan(raw: bytes) -> list[tuple[int, int, str]]:
    """Spans ``(start, end, kind)`` in code points, end exclusive, by start and
    then kind as listed; leftmost and not overlapping within a kind."""
    spans = []
    past = dict.fromkeys(KINDS, 0)
    hits = [(end + 1 - size, kind, pattern) for end, (size, kind, pattern) in _automaton().iter(raw.lower().decode("latin-1"))]
    for start, kind, pattern in sorted(hits, key=lambda h: h[0]):
        if start >= past[kind] and (match := pattern.match(raw, start)):
            past[kind] = match.end()
            if _checked(kind, match):
                spans.append((start, match.end(), kind))
    digits, at = raw.translate(_HEX_DIGITS), 0
    while (at := digits.find(b"x" * 24, at)) >= 0:
        match = _HEX.match(raw, at)
        spans.append((at, match.end(), "hex"))
        at = match.end()
    if not spans:
        return spans
    spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    if raw.isascii():
        return spans
    points, low, place = {}, 0, 0
    for x in sorted({y for s in spans for y in s[:2]}):
        place += len(raw[low:x].decode())
        points[x] = place
        low = x
    return [(points[a], points[b], kind) for a, b, kind in spans]


def _joined(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def _scans():
    def step(batch):
        found = [scan(raw) for raw in raw_texts(batch.column(1))]
        counts = [[sum(s[2] == kind for s in spans) for spans in found] for kind in BASE]
        base = [hashlib.sha256(_joined(s for s in spans if s[2] in BASE).encode()).hexdigest() for spans in found]
        return batch.column(0), *counts, base, [_joined(s) for s in found]

    return step


def secret_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, digest of the base spans and all spans, a row for each row of
    ``docs``; null and empty texts have none; repeated rows each return."""
    return arrow_map(docs, {"doc_id": F.col(doc_id).cast("long"), "text": F.col(text)}, _scans, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str) -> str:
    """The text with each secret replaced by its kind in brackets; spans that
    overlap become one, named by the first."""
    out, past = [], 0
    spans = scan(text.encode())
    while spans:
        start, end, kind = spans.pop(0)
        while spans and spans[0][0] < end:
            end = max(end, spans.pop(0)[1])
        out += [text[past:start], f"[{kind}]"]
        past = end
    return "".join([*out, text[past:]])


def redacted(text: Column) -> Column:
    """``redact`` as a column; null stays null."""

    @F.pandas_udf("string")
    def replaced(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else redact(t))

    return replaced(text)
