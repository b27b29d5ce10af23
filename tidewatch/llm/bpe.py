"""BPE encoding and decoding with contiguous rank arrays.

A short word is a row of part ids beside a row of the ranks of adjacent
pairs. Repeatedly the row is scanned for its minimum, that boundary is
deleted, and the two neighbouring ranks are refreshed. All distinct short
words of a batch take each step together, as rows of one matrix, so a step is
a few numpy calls. Longer words use a heap of boundaries, as a scan per merge
would be quadratic in them.

Null texts count as empty (no ids, empty decoding). Repeated rows stay rows;
extra columns are ignored. Texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices_by_size, to_arrow
from .tokens import CachedEncoder, WordTokens, byte_letters

#: Words of more parts than this take the heap.
SHORT = 32
#: Rows of one matrix.
ROWS = 8192
_NONE = np.int32(2**31 - 1)


class RankMerge:
    """Maps pre-tokens in byte letters to ids by the file's merges."""

    def __init__(self, spec: WordTokens):
        vocab, letters = spec.vocab, byte_letters()
        self.first = {c: vocab[c] for c in letters}
        self.last = {c: vocab[c + spec.suffix] for c in letters}
        # The same by code point: a row for letters within a word, one for its last.
        self.part_of = np.zeros((2, max(map(ord, letters)) + 1), np.int32)
        for c in letters:
            self.part_of[:, ord(c)] = self.first[c], self.last[c]
        self.size = max(vocab.values()) + 1
        ranks: dict[int, int] = {}
        for r, (a, b) in enumerate(spec.merges):
            ranks[vocab[a] * self.size + vocab[b]] = r  # a repeated pair keeps its last rank, as in the library
        self.ranks = ranks
        self.made = np.array([vocab[a + b] for a, b in spec.merges], np.int32)
        keys = np.array(sorted(ranks), np.int64)
        self.keys, self.rank_of = keys, np.array([ranks[k] for k in keys.tolist()], np.int32)

    one = staticmethod(lambda i: [i])

    def __call__(self, pieces: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(pieces)
        order = sorted((i for i, p in enumerate(pieces) if len(p) <= SHORT), key=lambda i: len(pieces[i]))
        for at in range(0, len(order), ROWS):
            rows = order[at : at + ROWS]
            for i, ids in zip(rows, self._short([pieces[i] for i in rows]), strict=True):
                out[i] = ids
        for i, p in enumerate(pieces):
            if len(p) > SHORT:
                out[i] = self._long(self._parts(p))
        return out

    def _parts(self, piece: str) -> list[int]:
        return [*map(self.first.__getitem__, piece[:-1]), self.last[piece[-1]]]

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; a part below 0 stands for none."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.rank_of[at], _NONE)

    def _short(self, words: list[str]) -> list[list[int]]:
        size = np.array(list(map(len, words)))
        width = int(size.max())
        # A column of -1 on either side, so that every boundary has neighbours.
        part = np.full((len(words), width + 2), -1, np.int32)
        code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        last = np.zeros(len(code), np.int8)
        last[np.cumsum(size) - 1] = 1
        part[:, 1:-1][np.arange(width) < size[:, None]] = self.part_of[last, code]
        rank = self._rank(part[:, :-1], part[:, 1:])
        done: list = [None] * len(words)
        row = np.arange(len(words))
        col = np.arange(width + 2)
        while len(row):
            at = rank.argmin(1)
            each = np.arange(len(row))
            low = rank[each, at]
            if (ended := low == _NONE).any():
                full = part[ended]
                held = full >= 0
                ids, end = full[held].tolist(), np.cumsum(held.sum(1)).tolist()
                for i, s, e in zip(row[ended].tolist(), [0, *end], end, strict=False):
                    done[i] = ids[s:e]
                row, part, rank, at, low = row[~ended], part[~ended], rank[~ended], at[~ended], low[~ended]
                each = np.arange(len(row))
                if not len(row):
                    break
            part[each, at] = self.made[low]
            move = col[:-1] > at[:, None]
            part[:, :-1] = np.where(move, part[:, 1:], part[:, :-1])
            part[:, -1] = -1
            rank[:, :-1] = np.where(move[:, :-1] | (col[:-2] == at[:, None]), rank[:, 1:], rank[:, :-1])
            rank[:, -1] = _NONE
            rank[each, at - 1] = self._rank(part[each, at - 1], part[each, at])
            rank[each, at] = self._rank(part[each, at], part[each, at + 1])
        return done

    def _long(self, part: list[int]) -> list[int]:
        n, size, ranks = len(part), self.size, self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get(part[i] * size + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if part[i] < 0 or j >= n or ranks.get(part[i] * size + part[j]) != r:
                continue  # the boundary has gone or its parts have changed
            part[i], part[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := ranks.get(part[k] * size + part[after[k]])) is not None:
                    heapq.heappush(heap, (r, k))
        return [p for p in part if p >= 0]


def decoder(spec: WordTokens):
    """ids -> text in UTF-8: the tokens themselves, one space between (the file names no decoder)."""
    token = {i: t.encode() for t, i in (spec.vocab | spec.special).items()}
    return lambda ids: b" ".join(map(token.__getitem__, ids))


def kept(spec: WordTokens, ids: list[int]) -> bytes:
    """What is kept of a pre-token: its ids as 32-bit integers."""
    return array("I", ids).tobytes()


joined = b"".join

DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode every text and decode it again; one row per document with digests of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = CachedEncoder(path, RankMerge, kept, joined)
        decode, decimal = decoder(encode.spec), [str(i).encode() for i in range(max((encode.spec.vocab | encode.spec.special).values()) + 1)]
        for b in slices_by_size(batches, 1, rows=2048):
            n, coded, texts = [], [], []
            for chunks in encode(b.column(1).to_pylist()):
                ids = array("I", b"".join(chunks))
                n.append(len(ids))
                coded.append(hashlib.sha256(b" ".join(map(decimal.__getitem__, ids))).hexdigest())
                texts.append(hashlib.sha256(decode(ids)).hexdigest())
            yield to_arrow(DIGEST, doc_id=b.column(0), n_tokens=n, ids_sha256=coded, decoded_sha256=texts)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
