"""Bounded-space online packing of token sequences.

Each partition keeps at most ``OPEN`` windows. A document's full windows leave
at once; its rest goes where it fits best (the least room that is enough).
When it fits nowhere and every window is in use, the fullest leaves: topped up
with the head of the piece if at least ``LEAST_CUT`` ids of room are left (so
hardly any padding remains). What is open at the end of the partitions is
merged, the windows of ``MERGE`` partitions at a time, into full sequences and
one tail, which is cut at powers of two.

State per task: ``OPEN`` windows, whatever the size of a document. Only
leftovers (at most ``OPEN`` windows per partition) move in a shuffle.

Null texts count as empty: a document always has its end id. Repeated rows are
packed as rows; extra columns are ignored; an empty table gives no sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices_by_size, to_arrow
from .tokens import ColumnEncoder, WordTokens

WINDOW = 2048
END = 1
OPEN = 32
LEAST_CUT = 16
MERGE = 16
#: Tails under this are not cut any further but padded.
LEAST_TAIL = 64
#: Sequence ids: the partition (or the merged group, with MERGED) above the number within it.
SHIFT, MERGED = 36, 1 << 62

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
SQL_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed(spec: WordTokens, ids: bytes) -> bytes:
    """What is kept of a pre-token: its ids as they are."""
    return ids


class Piece:
    __slots__ = ("doc_id", "start", "ids", "doc_tokens")

    def __init__(self, doc_id, start, ids, doc_tokens):
        self.doc_id, self.start, self.ids, self.doc_tokens = doc_id, start, ids, doc_tokens

    def split(self, at: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[:at], self.doc_tokens), Piece(self.doc_id, self.start + at, self.ids[at:], self.doc_tokens)


class Windows:
    """The open windows of one partition."""

    def __init__(self, window: int = WINDOW, most: int = OPEN, least_cut: int = LEAST_CUT):
        self.window, self.most, self.least_cut = window, most, least_cut
        self.room: list[int] = []
        self.held: list[list[Piece]] = []

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Take a piece; yields the sequences that are finished."""
        while len(piece.ids) >= self.window:
            head, piece = piece.split(self.window)
            yield [head]
        while n := len(piece.ids):
            fits = min((r for r in self.room if r >= n), default=None)
            if fits is None and len(self.room) < self.most:
                self.room.append(self.window)
                self.held.append([])
                fits = self.window
            if fits is not None:
                i = self.room.index(fits)
                self.held[i].append(piece)
                self.room[i] -= n
                if not self.room[i]:
                    yield self._leave(i)
                return
            i = self.room.index(room := min(self.room))
            if room >= self.least_cut:
                head, piece = piece.split(room)
                self.held[i].append(head)
            yield self._leave(i)

    def _leave(self, i: int) -> list[Piece]:
        self.room.pop(i)
        return self.held.pop(i)


def merge(windows: list[list[Piece]], window: int = WINDOW) -> Iterator[list[Piece]]:
    """Leftover windows, fullest first, end to end in full sequences; the tail at powers of two."""
    size = lambda w: sum(len(p.ids) for p in w)
    total = sum(map(size, windows))
    lengths = [window] * (total // window) + [1 << b for b in range(window.bit_length() - 1, -1, -1) if (total % window) >> b & 1 and 1 << b >= LEAST_TAIL]
    now: list[Piece] = []
    room = lengths.pop(0) if lengths else window
    for p in (p for w in sorted(windows, key=size, reverse=True) for p in w):
        while len(p.ids) >= room:
            head, p = p.split(room)
            yield [*now, head]
            now, room = [], lengths.pop(0) if lengths else window
        if len(p.ids):
            now.append(p)
            room -= len(p.ids)
    if now:
        yield now


def rows(sequences, first: int) -> dict[str, list]:
    out: dict[str, list] = {n: [] for n in PIECES.names}
    for k, seq in enumerate(sequences, first):
        at = 0
        for p in seq:
            for name, v in zip(PIECES.names, (p.doc_id, p.start, len(p.ids), zlib.crc32(p.ids.tobytes()), p.doc_tokens, k, at), strict=True):
                out[name].append(v)
            at += len(p.ids)
    return out


def pack(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """One row per piece: where its ids stand in the document and in the sequence."""
    held = pa.schema([*PIECES, ("part", pa.int32()), ("ids", pa.binary())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, windows = ColumnEncoder(path), Windows()
        part, tail = TaskContext.get().partitionId(), np.array([end], "<u4")
        count = part << SHIFT
        for b in slices_by_size(batches, 1, rows=4096, size=1 << 23):
            done = []
            column, offsets = encode(b.column(1))
            for doc_id, s, e in zip(b.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                ids = np.concatenate([column[s:e], tail])
                done += windows.add(Piece(doc_id, 0, ids, len(ids)))
            out = rows(done, count)
            count += len(done)
            n = len(out["doc_id"])
            yield to_arrow(held, **out, part=[part] * n, ids=[None] * n)
        out = rows(windows.held, count)
        pieces = [p.ids.tobytes() for w in windows.held for p in w]
        yield to_arrow(held, **out, part=[part] * len(pieces), ids=pieces)

    def join(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        by: dict[int, list[Piece]] = {}
        for r in table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist():
            by.setdefault(r["sequence_id"], []).append(Piece(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"]))
        out = rows(merge(list(by.values())), MERGED | key[0].as_py() << SHIFT)
        return pa.Table.from_batches([to_arrow(PIECES, **out)])

    placed = cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(place, SQL_PIECES + ", part int, ids binary"))
    left = placed.where("ids is not null").withColumn("to", F.floor(F.col("part") / MERGE))
    return placed.where("ids is null").select(*PIECES.names).unionByName(left.groupBy("to").applyInArrow(join, SQL_PIECES))
