"""Maximal runs of repeated word sequences, by online dyadic square catching.

The words of a batch of texts are appended to one sequence, a mark that occurs
once after each text, longest texts first. At level k the last completed block
of 2**k words is a catcher: each appended word moves the suffix of 2**k words
on, and a suffix that equals the catcher, q words behind it, is caught as the
front of a square of period q (2**k <= q < 2**(k+1); level 3 also takes
smaller q). Caught blocks that follow each other with one q merge, the merged
stretch is compared word by word and on to both sides, and a stretch of at
least max(LEAST, 3 * q) words is a run.

Suffixes are compared by hashes that double from level to level; equality is
confirmed on the words, so a collision can add work but no run, and equal
suffixes always have equal hashes. A run of period q is at least 3*q long, so
it holds a whole block of the level followed by its copy: no run is missed.

Inside runs of much smaller period p a block has many copies. A run of larger
period there must carry an end of the small run to the same end of another
one, so of such copies only those are followed whose distance is that of two
starts or two ends. Each block then follows a few copies, and a level costs
time in proportion to its words.

Words are runs of anything but ASCII white space. Null and empty texts have no
words. Null ids and repeated rows stay rows; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import slices_by_size

#: Words of a run at least; and three periods.
LEAST = 24
#: Level of the smallest catchers: runs of LEAST words hold one of their blocks and its copy.
FIRST = 3
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _doubled(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of windows of 2 * size words from those of size words."""
    a, b = h[: len(h) - size], h[size:]
    x = a * _ODD[0] + (b ^ (b >> np.uint64(29)))
    return (x ^ (x >> np.uint64(32))) * _ODD[1]


def _stretch(words: np.ndarray, lo: int, hi: int, q: int) -> tuple[int, int] | None:
    """The widest [lo, hi) around the given one in which words equal those q on; None if the given has an unequal one."""
    if not np.array_equal(words[lo:hi], words[lo + q : hi + q]):
        return None
    step = 32
    while lo:
        n = min(step, lo)
        odd = np.flatnonzero(words[lo - n : lo] != words[lo - n + q : lo + q])
        if len(odd):
            lo += int(odd[-1]) + 1 - n
            break
        lo, step = lo - n, step * 2
    step = 32
    while n := min(step, len(words) - q - hi):
        odd = np.flatnonzero(words[hi : hi + n] != words[hi + q : hi + q + n])
        if len(odd):
            hi += int(odd[0])
            break
        hi, step = hi + n, step * 2
    return lo, hi


def _caught(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(block start, suffix start) of each suffix that equals the catcher before it."""
    full = len(h) // size
    if not full:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    catchers = h[: full * size : size]
    row, col = np.nonzero(h[size : full * size].reshape(full - 1, size) == catchers[:-1, None])
    tail = np.flatnonzero(h[full * size :] == catchers[-1])
    return np.concatenate([row * size, np.full(len(tail), (full - 1) * size)]), np.concatenate([(row + 1) * size + col, full * size + tail])


def _caught_near(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for distances below the block's size."""
    at = np.arange(0, len(h), size)
    found = [(b[same], b[same] + q) for q in range(1, size) for b in [at[at + q < len(h)]] for same in [h[b] == h[b + q]]]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _followed(b: np.ndarray, j: np.ndarray, size: int, runs: list[tuple[int, int, int]], upto: int) -> np.ndarray:
    """Which caught pairs can be of a run that no found one of much smaller period explains."""
    small = [r for r in runs if 3 * r[2] <= size <= r[1] - r[0] and r[0] < upto]
    if not small:
        return np.ones(len(b), bool)
    owner = np.full(upto, -1, np.int32)
    for i, (start, end, _) in enumerate(small):
        owner[start : max(start, end - size + 1)] = i  # a window lies in one such run at most
    starts, ends = (np.array([r[x] for r in small]) for x in (0, 1))
    one, other = owner[b], owner[j]
    apart = j - b
    return (one < 0) | ((other >= 0) & ((starts[other] - starts[one] == apart) | (ends[other] - ends[one] == apart)))


def _merge(words: np.ndarray, b: np.ndarray, j: np.ndarray, size: int, upto: int, runs: dict[tuple[int, int], int]) -> None:
    """Caught pairs merged into stretches; those long enough are added to ``runs``, (start, end) -> period."""
    if not len(b):
        return
    go = _followed(b, j, size, [(s, e, p) for (s, e), p in runs.items()], upto)
    b, q = b[go], (j - b)[go]
    order = np.lexsort((b, q))
    b, q = b[order], q[order]
    cut = np.flatnonzero((q[1:] != q[:-1]) | (b[1:] - b[:-1] != size)) + 1
    for blocks, periods in zip(np.split(b, cut), np.split(q, cut), strict=True):
        if not len(blocks):
            continue
        p, lo, hi = int(periods[0]), int(blocks[0]), int(blocks[-1]) + size
        pieces = [_stretch(words, lo, hi, p)]
        if pieces[0] is None:  # a hash collided: the blocks one by one
            pieces = [_stretch(words, x, x + size, p) for x in range(lo, hi, size)]
        for s, e in filter(None, pieces):
            if e - s + p >= max(LEAST, 3 * p):
                runs.setdefault((s, e + p), p)  # smaller periods come first


def catch(words: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs in ``words``, by start, then period.

    ``words`` holds numbers for the words of texts of the given falling
    lengths, each followed by a number that occurs nowhere else.
    """
    runs: dict[tuple[int, int], int] = {}
    ends = np.cumsum(lengths + 1)
    h = words.astype(np.uint64) * _ODD[1] + _ODD[0]
    h ^= h >> np.uint64(31)
    size = 1
    while True:
        texts = int(np.searchsorted(-lengths, -max(LEAST, 3 * size), "right"))
        upto = int(ends[texts - 1]) if texts else 0
        h = h[: max(0, upto - size + 1)]
        if not len(h):
            break
        if size == 1 << FIRST:
            _merge(words, *_caught_near(h, size), size, upto, runs)
        if size >= 1 << FIRST:
            _merge(words, *_caught(h, size), size, upto, runs)
        h = _doubled(h, size)
        size *= 2
    return sorted(((s, e, p) for (s, e), p in runs.items()), key=lambda r: (r[0], r[2]))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and how many each text has."""
    split = pc.ascii_split_whitespace(texts)
    flat, owner = pc.list_flatten(split), pc.list_parent_indices(split)
    full = pc.not_equal(pc.binary_length(flat), 0)
    return flat.filter(full), np.bincount(owner.filter(full).to_numpy(), minlength=len(texts)).astype(np.int64)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])


def _of_batch(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    flat, counts = words_of(texts)
    code = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    begins = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    marks = len(code) + np.arange(len(counts))
    line = np.concatenate([x for d in order.tolist() for x in (code[begins[d] : begins[d] + counts[d]], marks[d : d + 1])]) if len(counts) else code
    places = np.cumsum(counts[order] + 1) - counts[order] - 1
    runs: list[list[dict]] = [[] for _ in counts]
    keep = np.ones(len(code), bool)
    for start, end, period in catch(line, counts[order]):
        at = int(np.searchsorted(places, start, "right")) - 1
        d, s = int(order[at]), start - int(places[at])
        runs[d].append({"start": s, "length": end - start, "period": period})
        keep[begins[d] + s + period : begins[d] + s + end - start] = False
    upto = np.r_[0, np.cumsum(keep)][np.r_[begins, len(code)]]
    left = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), flat.filter(pa.array(keep)))
    return pa.RecordBatch.from_arrays([ids, pa.array(counts), pa.array(runs, OUT.field("runs").type), pc.binary_join(left, " ")], schema=OUT)


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs array<struct<start, length, period>> by start, then period, and collapsed:
    the words left, joined by one space, when of every run only its first period stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices_by_size(batches, 1):
            yield _of_batch(b.column(0), b.column(1))

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
