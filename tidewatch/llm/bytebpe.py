"""Byte-level BPE by the tiktoken library with a local rank file.

The rank file holds base64 tokens and their ranks; ``pattern`` cuts a text
into the matches that are merged separately. A long text is cut first, near
every ``PART`` characters, at places where a match ends whatever stands
around it: behind a letter or digit and before white space or a mark. Up to
there the pattern sees the same text, and from there on it looks back at
nothing, so the ids of the parts are the ids of the whole. Where no such place
comes, the part grows until one does.

Decoding joins the tokens' raw bytes, as an id may end within a character.

Null texts count as empty (no ids, no bytes). Null ids and repeated rows stay
rows; extra columns are ignored; an empty table gives no rows. Special tokens
are not known: their strings are ordinary text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .common import slices, slices_by_size, to_arrow, worker_state

#: Characters of a text that go to the library at once.
PART = 1 << 16
# Letters and digits, and the white space and marks after them, whose classes are the same in all Unicode versions.
_SAFE = re.compile("(?<=[0-9A-Za-zÀ-ÖØ-öø-ɏΑ-ΡΣ-Ωα-ωА-яא-תぁ-ゖァ-ヺ一-龥가-힣])(?=[ \\n\\r\\t.,;:!?()\"'。、，！？])")


def library(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file, made once per worker."""
    known = worker_state("tiktoken")
    if (path, pattern) not in known:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}
        known[path, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return known[path, pattern]


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut at safe places only."""
    at = 0
    while len(text) - at > size and (found := _SAFE.search(text, at + size)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def encode_text(encoding: tiktoken.Encoding, text: str | None, size: int = PART) -> np.ndarray:
    if not text:
        return np.zeros(0, np.int32)
    if len(text) <= size:
        return np.asarray(encoding.encode_ordinary(text), np.int32)
    return np.concatenate([np.asarray(encoding.encode_ordinary(p), np.int32) for p in parts(text, size)])


TOKENS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
TEXTS = pa.schema([*TOKENS, ("decoded", pa.binary())])


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int> of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = library(path, pattern)
        for b in slices_by_size(batches, 1):
            ids = [encode_text(encoding, t) for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids)))], schema=TOKENS)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids, decoded binary: the raw bytes of the ids (null ids: none). An unknown id is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = library(path, pattern)
        for b in slices(batches):
            yield to_arrow(TEXTS, doc_id=b.column(0), ids=b.column(1), decoded=[encoding.decode_bytes(ids or []) for ids in b.column(1).to_pylist()])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
