"""Token ids in binary files by an adaptive context-mixing range coder.

Ids are cut into blocks of ``BLOCK``. An order-2 and an order-1 context each
predict one id, the one that mostly followed, with a confidence that grows while
they are right. The hit rates of both confidences are mixed with a learned
weight, and what was seen of the two confidences together refines the mixture.
Misses fall to an order-0 model: how often each id of the segment was one so
far. The probabilities drive a 64-bit range coder with carry and 16-bit words.

The blocks of a segment are coded in step, one numpy lane each, and share one
model, which learns from all of them after every ``ROUND`` steps. The ids of a
segment are coded by their rank among its distinct ids. All arithmetic is that
of integers, so files read the same everywhere. Each block has a checksum, and
so has the head; a segment with a damaged part is refused as a whole.

Segment (little endian): "TWI3", u32 blocks, u32 bytes of the distinct ids, u32
crc32 of the rest of the head: per block u32 ids, u32 words, u32 crc32 of the
ids as u32; then the distinct ids (differences as u32, deflated); then the
16-bit words of each block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices, slices_by_size, to_arrow
from .tokens import ColumnEncoder

MAGIC = b"TWI3"
BLOCK = 1024
#: Blocks coded in step.
LANES = 4096
#: A segment is closed at the first end of a document beyond so many ids.
SEGMENT = BLOCK * LANES
END = 1

#: Steps between two updates of the model.
ROUND = 32

#: Entries of the order-2 table, and how two ids choose one.
_ORDER2 = 1 << 20
_MIX1, _MIX2, _SHIFT = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(32 - 20)
#: Confidences are below 2**3; a state is those of both contexts and whether they predict the same id.
_SURE = 7
_STATES = 2 * (_SURE + 1) ** 2
#: The shares of the coder's range, of 2**16, and the least of a predicted id and of a miss.
_BITS = 16
_ONE = 1 << _BITS
_FLOOR = 32
#: What an order-0 miss adds to its id's count of 1.
_SEEN = 16
#: Cases that the mixture counts for against those of its state; a state's cases are halved beyond _MOST.
_PRIOR, _MOST = 64, 1 << 20
_LEAST = np.uint64(1 << 48)
_U = np.uint64


class Model:
    """Predictions of one segment, adapted to all its lanes; ids are ranks below ``n``."""

    def __init__(self, n: int):
        # Predicted id and confidence, packed; none yet.
        self.next1 = np.full(n + 1, -_SURE - 1, np.int32)
        self.next2 = np.full(_ORDER2, -_SURE - 1, np.int32)
        self.count = np.ones(n, np.int64)
        state = np.arange(_STATES)
        self.same, self.c1, self.c2 = state & 1, state >> 1 & _SURE, state >> 4
        #: Cases of each state: order 2 right, order 1 right, both wrong.
        self.cases = np.zeros((3, _STATES), np.int64)
        self.weight = np.full(_STATES, 2048)
        self._derive()

    def _derive(self) -> None:
        """The tables that a round codes with."""
        upto = np.cumsum(self.count)
        self.total = _U(int(upto[-1]))
        self.upto = upto.astype(np.int32) if upto[-1] < 1 << 31 else upto  # a smaller table is searched faster
        self.below = self.upto - self.count.astype(self.upto.dtype)
        hit2, hit1, _ = self.cases
        n = self.cases.sum(0)

        def rate(of: np.ndarray, hits: np.ndarray, cases: np.ndarray) -> np.ndarray:
            total, right = np.zeros(_SURE + 1, np.int64), np.zeros(_SURE + 1, np.int64)
            np.add.at(total, of, cases)
            np.add.at(right, of, hits)
            return ((right * _ONE + (np.arange(_SURE + 1) << 13)) // (total + 1))[of]

        # Order 2's own rate, and what order 1's says of order 2's id: its own rate where both predict it.
        self.own = np.minimum(rate(self.c2, hit2, n), _ONE)
        also = np.minimum(rate(self.c1, np.where(self.same, hit2, hit1), n), _ONE)
        self.other = np.where(self.same, also, _ONE - also)
        self.mixed = self.other + (self.weight * (self.own - self.other) >> 12)
        left = n - hit2
        alone = np.minimum(rate(self.c1, hit1 * (1 - self.same), left * (1 - self.same)), _ONE)
        f2 = (hit2 * _ONE + _PRIOR * self.mixed) // (n + _PRIOR)
        f2 = np.clip(f2, _FLOOR, _ONE - 2 * _FLOOR) * (self.c2 > 0)
        f1 = (_ONE - f2) * ((hit1 * _ONE + _PRIOR * alone) // (left + _PRIOR)) >> _BITS
        f1 = np.clip(f1, _FLOOR, _ONE - _FLOOR - f2) * ((self.c1 > 0) & (self.same == 0))
        self.f2, self.hits = f2.astype(_U), (f2 + f1).astype(_U)
        # By outcome and state: where its share starts, and how much it is.
        self.start = np.concatenate([0 * f2, f2, f2 + f1]).astype(_U)
        self.share = np.concatenate([f2, f1, _ONE - f2 - f1]).astype(_U)

    def predict(self, prev: np.ndarray, prev2: np.ndarray) -> tuple[np.ndarray, ...]:
        """Place in the order-2 table, both entries, both predicted ids, state."""
        i2 = (prev.view(np.uint32) * _MIX1 + prev2.view(np.uint32) * _MIX2) >> _SHIFT
        e1, e2 = self.next1.take(prev), self.next2.take(i2)
        p1, p2 = e1 >> 3, e2 >> 3
        return i2, e1, e2, p1, p2, ((e2 & _SURE) << 4 | (e1 & _SURE) << 1) + (p1 == p2)

    def learn(self, ids: np.ndarray, prev: np.ndarray, i2: np.ndarray, e1: np.ndarray, e2: np.ndarray, case: np.ndarray) -> None:
        """A round's ids (in the order of steps, then lanes) with what was predicted; ``case`` is outcome * states + state."""
        new = ids << 3 | 1
        for table, at, e in ((self.next1, prev, e1), (self.next2, i2, e2)):
            # Right: surer; wrong: less sure, or the new id. Of one context's entries in a round the last stays.
            wrong = np.where((e & _SURE) < 2, new, e - 1)
            table[at] = np.where(e >> 3 == ids, np.minimum(e + 1, e | _SURE), wrong)
        now = np.bincount(case, minlength=3 * _STATES).reshape(3, _STATES)
        n = now.sum(0)
        error = now[0] * _ONE - n * self.mixed
        step = np.clip((error // np.maximum(n, 1)) * (self.own - self.other) >> 20, -256, 256)
        self.weight = np.clip(self.weight + step, 0, 4096)
        self.cases += now
        self.cases >>= (self.cases.sum(0) > _MOST).astype(np.int64)
        self.count += _SEEN * np.bincount(ids[case >= 2 * _STATES], minlength=len(self.count))
        self._derive()


def _head(distinct: np.ndarray, index: np.ndarray) -> bytes:
    table = zlib.compress(np.diff(distinct, prepend=0).astype("<u4").tobytes(), 6)
    rest = index.astype("<u4").tobytes() + table
    return MAGIC + np.array([len(index), len(table), zlib.crc32(rest)], "<u4").tobytes() + rest


def _ranks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, and of each id its rank among them."""
    if len(ids) and int(ids.max()) < 1 << 20:
        there = np.zeros(int(ids.max()) + 1, bool)
        there[ids] = True
        return np.flatnonzero(there), (np.cumsum(there, dtype=np.int32) - np.int32(1)).take(ids)
    distinct, rank = np.unique(ids, return_inverse=True)
    return distinct.astype(np.int64), rank.astype(np.int32)


def encode(ids: np.ndarray) -> bytes:
    """A segment of any number of ids below 2**28."""
    ids = np.asarray(ids, "<u4")
    lanes = -(-len(ids) // BLOCK)
    if not lanes:
        return _head(ids, np.zeros((0, 3)))
    if int(ids.max()) >= 1 << 28:
        raise ValueError("ids are below 2**28")
    distinct, rank = _ranks(ids)
    steps, n_ids = min(BLOCK, len(ids)), len(distinct)
    # Two rows before the first step: no id yet.
    rows = np.zeros((lanes, BLOCK), np.int32)
    rows.reshape(-1)[: len(ids)] = rank
    columns = np.empty((steps + 2, lanes), np.int32)
    columns[:2], columns[2:] = n_ids, rows.T[:steps]
    m = Model(n_ids)
    low, rng = np.zeros(lanes, _U), np.full(lanes, 2**64 - 1, _U)
    out, n = np.zeros((lanes, 4 * steps + 8), "<u2"), np.zeros(lanes, np.int64)
    flat, base = out.reshape(-1), np.arange(lanes) * out.shape[1]

    def carry(which: np.ndarray) -> None:
        at = n[which] - 1
        while len(which):
            out[which, at] += 1
            more = out[which, at] == 0
            which, at = which[more], at[more] - 1

    def shift(which: np.ndarray) -> None:
        some = low[which]
        flat[base[which] + n[which]] = some >> _U(48)
        n[which] += 1
        low[which] = some << _U(16)

    for t in range(0, steps, ROUND):
        end = min(t + ROUND, steps)
        now, prev, prev2 = (columns[t + k : end + k].ravel() for k in (2, 1, 0))
        i2, e1, e2, p1, p2, state = m.predict(prev, prev2)
        case = np.where(now == p2, 0, np.where(now == p1, _STATES, 2 * _STATES)) + state
        start, share = m.start.take(case), m.share.take(case)
        missed = np.flatnonzero(case >= 2 * _STATES)
        other = now.take(missed)
        below, count = m.below.take(other).astype(_U), m.count.take(other).astype(_U)
        cuts = np.searchsorted(missed, np.arange(end - t + 1) * lanes).tolist()
        for k in range(end - t):
            s, of = slice(k * lanes, k * lanes + lanes), slice(cuts[k], cuts[k + 1])
            r = rng >> _U(_BITS)
            grown, rng = low + r * start[s], r * share[s]
            at = missed[of] - k * lanes
            r = rng.take(at) // m.total
            grown[at] += r * below[of]
            rng[at] = r * count[of]
            over = grown < low
            low = grown
            if over.any():
                carry(np.flatnonzero(over))
            while len(small := np.flatnonzero(rng < _LEAST)):
                shift(small)
                rng[small] <<= _U(16)
        m.learn(now, prev, i2, e1, e2, case)
    for _ in range(4):
        shift(np.arange(lanes))
    counts = np.full(lanes, BLOCK)
    counts[-1] = len(ids) - BLOCK * (lanes - 1)
    crc = [zlib.crc32(ids[k * BLOCK : (k + 1) * BLOCK]) for k in range(lanes)]
    return _head(distinct, np.array([counts, n, crc]).T) + b"".join(out[k, : n[k]].tobytes() for k in range(lanes))


def decode(data: bytes) -> np.ndarray:
    """The ids of a segment; raises ValueError where a checksum doesn't hold."""
    if data[:4] != MAGIC or len(data) < 16:
        raise ValueError("not a segment of token ids")
    lanes, size, check = np.frombuffer(data, "<u4", 3, 4).tolist()
    body = 16 + 12 * lanes + size
    if len(data) < body or zlib.crc32(data[16:body]) != check:
        raise ValueError("the head is damaged")
    if not lanes:
        return np.zeros(0, "<u4")
    counts, words, crc = np.frombuffer(data, "<u4", 3 * lanes, 16).reshape(lanes, 3).astype(np.int64).T
    distinct = np.cumsum(np.frombuffer(zlib.decompress(data[16 + 12 * lanes : body]), "<u4"), dtype=np.int64)
    if len(data) < body + 2 * int(words.sum()):
        raise ValueError("the segment is cut short")
    # Zeros behind the last block: a decoder looks at most four words ahead.
    stream = np.concatenate([np.frombuffer(data, "<u2", int(words.sum()), body), np.zeros(8, "<u2")])
    word = np.cumsum(words) - words
    n_ids, steps = len(distinct), int(counts.max())
    m = Model(n_ids)
    code, rng = np.zeros(lanes, _U), np.full(lanes, 2**64 - 1, _U)
    for _ in range(4):
        code = code << _U(16) | stream.take(word, mode="clip")
        word = word + 1
    columns = np.full((steps + 2, lanes), n_ids, np.int32)
    seen = []
    for t in range(steps):
        prev = columns[t + 1]
        i2, e1, e2, p1, p2, state = m.predict(prev, columns[t])
        r = rng >> _U(_BITS)
        v = code // r
        right2, wrong = v < m.f2.take(state), v >= m.hits.take(state)
        case = np.where(right2, 0, _STATES + wrong * _STATES) + state
        code = code - r * m.start.take(case)
        rng = r * m.share.take(case)
        now = np.where(right2, p2, p1)
        at = np.flatnonzero(wrong)
        r = rng.take(at) // m.total
        some = code.take(at)
        found = np.minimum(np.searchsorted(m.upto, (some // r).astype(m.upto.dtype), "right"), n_ids - 1)
        now[at] = found
        code[at] = some - r * m.below.take(found).astype(_U)
        rng[at] = r * m.count.take(found).astype(_U)
        while len(small := np.flatnonzero(rng < _LEAST)):
            here = word.take(small)
            code[small] = code.take(small) << _U(16) | stream.take(here, mode="clip")
            word[small] = here + 1
            rng[small] = rng.take(small) << _U(16)
        columns[t + 2] = now
        seen.append((i2, e1, e2, case))
        if len(seen) == ROUND:
            first = t + 1 - ROUND
            m.learn(columns[first + 2 : t + 3].ravel(), columns[first + 1 : t + 2].ravel(), *map(np.concatenate, zip(*seen, strict=True)))
            seen = []
    rows = distinct.astype("<u4").take(columns[2:].T)
    ids = np.concatenate([rows[k, :c] for k, c in enumerate(counts.tolist())])
    cuts = np.cumsum(counts)
    for k in range(lanes):
        if zlib.crc32(ids[cuts[k] - counts[k] : cuts[k]]) != crc[k]:
            raise ValueError(f"block {k} is damaged")
    return ids


FILES = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("data", pa.binary())])
ROWS = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def write(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """Segments in ascending order of doc_id: part, ids before it in its part, documents, data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = ColumnEncoder(path)
        part, tail, first = TaskContext.get().partitionId(), np.array([end], "<u4"), 0
        held: list[tuple[int, np.ndarray]] = []

        def segment() -> pa.RecordBatch:
            ids = np.concatenate([x for _, x in held])
            return to_arrow(FILES, part=[part], first=[first], n_ids=[len(ids)], doc_ids=[[d for d, _ in held]], lengths=[[len(x) for _, x in held]], data=[encode(ids)])

        size = 0
        for b in slices_by_size(batches, 1, rows=4096, size=1 << 23):
            column, offsets = encoded(b.column(1))
            for doc_id, s, e in zip(b.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                held.append((doc_id, np.concatenate([column[s:e], tail])))
                size += e - s + 1
                if size >= SEGMENT:
                    yield segment()
                    first, size, held = first + size, 0, []
        if held:
            yield segment()

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return cut(ordered.mapInArrow(run, "part int, first long, n_ids long, doc_ids array<long>, lengths array<long>, data binary"))


def read(files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            r = b.to_pylist()[0]
            ids, lengths = decode(r["data"]), np.array(r["lengths"], np.int64)
            ends = np.cumsum(lengths)
            crc = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), r["lengths"], strict=True)]
            yield to_arrow(ROWS, doc_id=r["doc_ids"], part=[r["part"]] * len(ends), first=r["first"] + ends - lengths, n_tokens=r["lengths"], ids_crc32=crc)

    rows = files.select("part", "first", "doc_ids", "lengths", "data").mapInArrow(run, "doc_id long, part int, first long, n_tokens long, ids_crc32 long")
    # One row per part: as many as the write had tasks, so the running sum and the broadcast are small.
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = parts.select(F.col("part"), before.alias("base"))
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
