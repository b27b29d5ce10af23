"""Secret scan: keyword automaton, anchored patterns near hits, checksums.

One Aho-Corasick pass over the lower-cased text finds keywords; a pattern is
only tried where its keyword starts. Token kinds with an embedded checksum are
kept only if it holds, JSON web tokens only if their header decodes.

Offsets are code points, ends exclusive. Null and empty texts have no spans.
Texts are scanned whole, row by row; nothing is shuffled. Repeated rows are
scanned as rows, extra columns are ignored (``scan``) or kept (``redact``).
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, to_arrow

#: Kinds in the order in which ties of start are listed.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "key")
BASE = KINDS[:3]

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")
_CHECKED = re.compile("(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_JWT = re.compile(r"(eyJ[\w-]{8,})\.eyJ[\w-]{4,}\.[\w-]{16,}", re.A)
_KEY = re.compile("-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----")

#: keyword in lower case -> kind
KEYWORDS = dict.fromkeys(("password", "passwd", "secret", "token", "apikey", "api_key"), "assign") | {"akia": "access", "npm_": "npm", "eyj": "jwt", "-----begin ": "key"} | {f"gh{c}_": "github" for c in "pousr"}

_LOWER = {c: c + 32 for c in range(65, 91)}
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_base62(body: str, digits: int = 6) -> str:
    """The checksum that these tokens end in: CRC-32 of the body in base 62."""
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        out = _BASE62[d] + out
    return out.rjust(digits, "0")


def _header(part: str) -> bool:
    try:
        head = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except ValueError:
        return False
    return isinstance(head, dict) and "alg" in head


_AT = {
    "assign": (_ASSIGN, lambda m: len(m[2]) >= 6),
    "access": (_ACCESS, lambda m: len(m[0]) >= 20),
    "github": (_CHECKED, lambda m: crc_base62(m[1]) == m[2]),
    "npm": (_CHECKED, lambda m: crc_base62(m[1]) == m[2]),
    "jwt": (_JWT, lambda m: _header(m[1])),
    "key": (_KEY, lambda m: True),
}


@lru_cache(maxsize=1)
def automaton():
    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (len(word), kind))
    a.make_automaton()
    return a


def find(text: str | None) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, start of the secret itself), by start, then kind."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):  # a few letters grow in lower case
        low = text.translate(_LOWER)
    hits: dict[str, list[int]] = {}
    for end, (n, kind) in automaton().iter(low):
        hits.setdefault(kind, []).append(end - n + 1)
    out = [(m.start(), m.end(), "hex", m.start()) for m in _HEX.finditer(text)]
    for kind, starts in hits.items():
        pattern, valid = _AT[kind]
        at = 0
        for s in sorted(starts):
            # Left to right without overlap: a match takes its span even if it then fails.
            if s >= at and (m := pattern.match(text, s)):
                at = m.end()
                if valid(m):
                    out.append((s, m.end(), kind, m.start(2) if kind == "assign" else s))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


SPANS = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts and digest of the base kinds, all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [find(t) for t in b.column(1).to_pylist()]
            text = lambda spans: ",".join(f"{k}:{s}:{e}" for s, e, k, _ in spans)
            base = [[x for x in f if x[2] in BASE] for f in found]
            count = {f"n_{k}": [sum(x[2] == k for x in f) for f in base] for k in BASE}
            yield to_arrow(SPANS, doc_id=b.column(0), **count, base_sha256=[hashlib.sha256(text(f).encode()).hexdigest() for f in base], spans=[text(f) for f in found])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def masked(text: str | None, mark: str = "[secret]") -> str | None:
    """The text with each secret (of an assignment, its value) replaced."""
    spans = sorted((v, e) for _, e, _, v in find(text))
    if not spans:
        return text
    out, at = [], 0
    for s, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns, with the secrets in ``text`` replaced."""
    schema, at = docs.schema, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.set_column(at, b.schema.field(at), pa.array([masked(t) for t in b.column(at).to_pylist()], b.schema.field(at).type))

    return docs.mapInArrow(run, schema)
