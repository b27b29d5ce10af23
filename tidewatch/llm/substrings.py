"""Near-duplicate passages by compact windows.

A text is its sequence of five-word shingles. Under one hash function the
Cartesian tree of the hashes gives, for each node, the widest window in which
it is the least: every passage inside that window and over that node has the
same min-hash. Windows of at least ``LEAST`` shingles (50 words) are kept, about
2n / LEAST of them for each of ``HASHES`` functions; a passage of 50 words that
two texts share lies under one window of each function in both, with equal
min-hashes.

Windows of equal min-hash meet: each with the first document's (a star, never
all pairs of a hot min-hash). For a pair of documents the windows' intervals
are laid over each other along their diagonal; where enough functions overlap,
the passages are aligned exactly and kept if they have at least 50 words and a
Jaccard similarity of ``SIMILAR``. Windows that no passage of their star holds (their
first document shares less than the passage) meet again with the first
document among those that also agree on a shingle 15 or 30 to either side.
Last, every run of 50 words that no passage holds yet and that an earlier
document may have meets the first document with the same run, so exact
repeats of 50 words are all found.

A row is a passage of ``doc_id`` that an earlier document (``first_id``) holds:
word offsets, ends exclusive. Null texts and texts under 50 words have none.
Rows of one doc_id with one text count as one document; each other text under
that doc_id is a document of its own, later than all doc_ids. Rows without
doc_id are not searched. A passage begins and ends with five equal words at least,
so where the words at its ends differ it is the part between them. Repeated rows
and extra columns of any name stay as they are; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shingles as S
from .common import cut, fresh, slices, to_arrow

WORDS = 50
LEAST = WORDS - S.WIDTH + 1
HASHES, ENOUGH = 4, 2
SIMILAR = 0.8
#: Shingles to either side of a window's node that tell its surroundings.
ANCHORS = (-30, -15, 15, 30)
#: Characters of the documents that are hashed together.
PORTION = 1 << 20
#: Shingles that may differ between two runs of one passage.
GAP = 12

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_SIDE = (1 << 16) - 1


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    n, w, m = len(v) - width + 1, 1, v
    while 2 * w <= width:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    return np.minimum(m[:n], m[width - w : width - w + n])


def compact_windows(h: np.ndarray, doc: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the Cartesian tree over each document's hashes (least on top, ties to the left), the nodes
    whose span is at least ``least``, and the first and last place of their spans.

    ``doc`` numbers the documents that follow each other in ``h``. Those nodes are the places that
    are least in some window of that width, and the nearest smaller places of a kept node are kept
    nodes, so the tree is only built over them.
    """
    n = len(h)
    if n < least:
        return (np.zeros(0, np.int64),) * 3
    bits = np.uint64(n.bit_length())
    v = h >> bits << bits | np.arange(n, dtype=np.uint64)  # ordered by hash, then place
    inside = doc[: n - least + 1] == doc[least - 1 :]
    at = (_sliding_min(v, least)[inside] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    at = at[np.flatnonzero(np.diff(at, prepend=-1))]
    value, where, of = v[at].tolist(), at.tolist(), doc[at].tolist()
    begin, end = np.searchsorted(doc, of).tolist(), (np.searchsorted(doc, of, "right") - 1).tolist()
    first, last, stack, now = begin, end, [], -1
    for i, x in enumerate(value):
        if of[i] != now:
            now, stack = of[i], []
        while stack and value[stack[-1]] > x:
            last[stack.pop()] = where[i] - 1
        if stack:
            first[i] = where[stack[-1]] + 1
        stack.append(i)
    return at, np.array(first, np.int64), np.array(last, np.int64)


WINDOWS = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("place", pa.int64()), ("around", pa.int64())])


def _portions(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of as many texts as hold PORTION characters, so that the arrays stay small."""
    at = 0
    while at < len(sizes):
        end, size = at + 1, sizes[at]
        while end < len(sizes) and size + sizes[end] <= PORTION:
            size += sizes[end]
            end += 1
        yield at, end
        at = end


def _shingles(texts: list[str]) -> list[np.ndarray]:
    """The shingles of each text, hashed together."""
    words, owner = S.together(texts)
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
    whole = S.of_words(words)
    return [whole[s : e - S.WIDTH + 1] if e - s >= S.WIDTH else S.of_words(words[s:e]) for s, e in zip(cuts, cuts[1:], strict=False)]


def _windows(ids: np.ndarray, texts: list[str]) -> list[np.ndarray]:
    """Columns of the windows of some documents."""
    words, owner = S.together(texts)
    whole = np.flatnonzero(owner[: len(words) - S.WIDTH + 1] == owner[S.WIDTH - 1 :]) if len(words) >= S.WIDTH else np.zeros(0, np.int64)
    if not len(whole):
        return [np.zeros(0, np.int64)] * 4
    s, doc = S.of_words(words)[whole], owner[whole]
    h = [S.mix(s ^ S._STEPS[k]) for k in range(HASHES)]
    found = [compact_windows(x, doc) for x in h]
    at, first, last = (np.concatenate([f[i] for f in found]) for i in range(3))
    key = np.concatenate([x[f[0]] >> np.uint64(2) << np.uint64(2) | np.uint64(k) for k, (x, f) in enumerate(zip(h, found, strict=True))])
    here = doc[at]
    local = at - np.searchsorted(doc, here)
    place = local << 32 | np.minimum(at - first, _SIDE) << 16 | np.minimum(last - at, _SIDE)
    side = np.zeros(len(at), np.uint64)
    reach = max(ANCHORS)
    mark = np.pad(s % np.uint64(_SIDE) + np.uint64(1), reach)
    same = np.pad(doc, reach, constant_values=-1)
    for j, step in enumerate(ANCHORS):
        there = at + reach + step
        side |= np.where(same[there] == here, mark[there], np.uint64(0)) << np.uint64(16 * j)
    return [key.view(np.int64), ids[here], place, side.view(np.int64)]


def windows(docs: DataFrame) -> DataFrame:
    """key (min-hash; its two low bits are the function), node, place (packed), surroundings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), [t or "" for t in b.column(1).to_pylist()]
            for at, end in _portions([len(t) for t in texts]):
                columns = _windows(ids[at:end], texts[at:end])
                if len(columns[0]):
                    yield to_arrow(WINDOWS, **dict(zip(WINDOWS.names, columns, strict=True)))

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "key long, node long, place long, around long")


def unpack(place):
    """First, node and last place of a window or of an array of them (spans are packed up to 65535 to a side)."""
    at = place >> 32
    return at - (place >> 16 & _SIDE), at, at + (place & _SIDE)


def enough(group: np.ndarray, k: np.ndarray, place: np.ndarray, first_place: np.ndarray, least: int = LEAST, need: int = ENOUGH) -> np.ndarray:
    """The groups of hits (windows of function ``k`` in two documents) in which some ``least`` shingles
    lie under windows of ``need`` functions at once. Groups and places are below 2**31."""
    (a1, a, a2), (b1, b, b2) = unpack(place), unpack(first_place)
    s, e = np.maximum(a1, a - (b - b1)), np.minimum(a2, a + (b2 - b)) + 1
    wide = np.flatnonzero(e - s >= least)  # one such passage begins at s..e-least
    s, e, group, k = s[wide], e[wide] - least + 1, group[wide], np.tile(k[wide], 2)
    step = np.repeat(np.array([1, -1]), len(s))
    where = np.tile(group, 2)
    order = np.lexsort((step, np.concatenate([s, e]), where))
    step, k = step[order], k[order]
    on = sum((np.cumsum(step * (k == j)) > 0).astype(np.int8) for j in range(HASHES))
    return np.unique(where[order][on >= need])


def _runs(a: np.ndarray, b: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    lo, hi = max(0, shift), min(len(a), len(b) + shift)
    if lo >= hi:
        return []
    edge = np.diff((a[lo:hi] == b[lo - shift : hi - shift]).astype(np.int8), prepend=0, append=0)
    return [(s, e, shift) for s, e in zip((np.flatnonzero(edge == 1) + lo).tolist(), (np.flatnonzero(edge == -1) + lo).tolist(), strict=True)]


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    x, y = np.unique(a), np.unique(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= SIMILAR * (len(x) + len(y) - both)


def align(a: np.ndarray, b: np.ndarray, shifts: set[int], least: int = LEAST, gap: int = GAP) -> list[tuple[int, int, int, int]]:
    """Passages (start, end in a; start, end in b) in shingles: runs of equal shingles near the
    diagonals, chained over short differences, cut at the widest until they are similar enough."""
    chains: list[list[tuple[int, int, int]]] = []
    open_: list[list[tuple[int, int, int]]] = []
    for run in sorted(r for d in shifts for r in _runs(a, b, d)):
        s, _, d = run
        open_ = [c for c in open_ if c[-1][1] + gap >= s]
        fits = [c for c in open_ if c[-1][1] <= s and 0 <= s - d - (c[-1][1] - c[-1][2]) <= gap]
        if fits:
            max(fits, key=lambda c: (c[-1][2] == d, c[-1][1])).append(run)
        else:
            open_.append([run])
            chains.append(open_[-1])
    out = []
    while chains:
        c = chains.pop()
        s, e, t, u = c[0][0], c[-1][1], c[0][0] - c[0][2], c[-1][1] - c[-1][2]
        if min(e - s, u - t) < least:
            continue
        if len(c) == 1 or _similar(a[s:e], b[t:u]):
            out.append((s, e, t, u))
        else:
            at = max(range(1, len(c)), key=lambda i: c[i][0] - c[i - 1][1])
            chains += [c[:at], c[at:]]
    return sorted(out)


def passages_of(a: np.ndarray, b: np.ndarray, hits: list[tuple[int, int]], size: int = 1) -> list[tuple[int, int, int, int]]:
    """Passages of a pair whose windows met at places (in a, in b): the diagonal with the most hits
    first, with its neighbours; hits (of ``size`` shingles) that a passage covers need no diagonal
    of their own."""
    out, left = [], hits
    while left:
        counts = Counter(x - y for x, y in left)
        best = min(counts, key=lambda d: (-counts[d], abs(d), d))
        near = {d for d in counts if abs(d - best) <= GAP}
        found = align(a, b, near)
        out += [f for f in found if not any(s <= f[0] and f[1] <= e for s, e, _, _ in out)]
        left = [(x, y) for x, y in left if x - y not in near and not any(s <= x and x + size <= e for s, e, _, _ in found)]
    return sorted(out)


PASSAGES = pa.schema([(n, pa.int64()) for n in ("node", "first", "start", "end", "first_start", "first_end")])


def _pairs(hits: DataFrame, need: int) -> DataFrame:
    """(node, first) with the places where their windows met, of pairs where enough functions overlap."""
    schema = pa.schema([("node", pa.int64()), ("first", pa.int64()), ("x", pa.list_(pa.int64())), ("y", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            hits = b.column(2)
            size = pc.list_value_length(hits).to_numpy(zero_copy_only=False)
            k, place, first_place = (hits.flatten().field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            group = np.repeat(np.arange(len(size)), size)
            ok = enough(group, k, place, first_place, need=need) if need > 1 else np.arange(len(size))
            kept = np.isin(group, ok)
            ends = pa.array(np.concatenate([np.zeros(1, np.int64), np.cumsum(size[ok])]), pa.int32())
            x, y = (pa.ListArray.from_arrays(ends, pa.array(v[kept] >> 32, pa.int64())) for v in (place, first_place))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ok)), b.column(1).take(pa.array(ok)), x, y], schema=schema)

    # As many windows as the two documents have: the group is bounded by their texts.
    function = F.col("key").bitwiseAND(F.lit(3))
    grouped = hits.groupBy("node", "first").agg(F.collect_list(F.struct(function.alias("k"), "place", "first_place")).alias("hits"))
    met = grouped.where(F.size(F.array_distinct(F.col("hits.k"))) >= need)
    return met.mapInArrow(run, "node long, first long, x array<long>, y array<long>")


def _verify(docs: DataFrame, pairs: DataFrame, hit: int = 1) -> DataFrame:
    """Passages of the pairs, whose hits are of ``hit`` shingles; a row of nulls where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            node, first, x, y = (b.column(i).to_pylist() for i in range(4))
            begin = [i for i in range(len(first)) if not i or first[i] != first[i - 1]]  # rows come by first document
            size = pc.binary_length(b.column(4)).to_numpy(zero_copy_only=False) + 0
            size[begin] += pc.binary_length(b.column(5)).to_numpy(zero_copy_only=False)[begin]
            for at, end in _portions(size.tolist()):
                new = [i for i in range(at, end) if i == at or first[i] != first[i - 1]]
                of = np.repeat(np.arange(len(new)), np.diff([*new, end])).tolist()
                theirs = b.column(5).take(pa.array(new)).to_pylist()
                s = _shingles([t or "" for t in b.column(4).slice(at, end - at).to_pylist() + theirs])
                out: dict[str, list] = {n: [] for n in PASSAGES.names}
                for i in range(at, end):
                    hits = list(zip(x[i], y[i], strict=True))
                    found = passages_of(s[i - at], s[end - at + of[i - at]], hits, size=hit)
                    for a, e, t, u in found or [(None,) * 4]:
                        # A passage of k shingles has k + WIDTH - 1 words.
                        ends = (a, e + S.WIDTH - 1, t, u + S.WIDTH - 1) if found else (None,) * 4
                        for n, v in zip(PASSAGES.names, (node[i], first[i], *ends), strict=True):
                            out[n].append(v)
                yield to_arrow(PASSAGES, **out)

    asked = pairs.select(F.col("node").alias("doc_id")).union(pairs.select("first")).distinct()
    # Texts, which are shuffled compressed, and once for both sides; their hashes would be larger.
    texts = docs.join(asked, "doc_id", "left_semi").groupBy("doc_id").agg(F.any_value("text").alias("text"))
    of = lambda n, t: texts.select(F.col("doc_id").alias(n), F.col("text").alias(t))
    both = pairs.join(of("node", "s_x"), "node").join(of("first", "s_y"), "first").select("node", "first", "x", "y", "s_x", "s_y")
    return both.mapInArrow(run, ", ".join(f"{n} long" for n in PASSAGES.names))


def _star(rows: DataFrame, *keys: str) -> DataFrame:
    """Each row with the first document of its key (the others of one key are not paired)."""
    first = rows.groupBy(*keys).agg(F.min(F.struct("node", "place")).alias("f"), F.max("node").alias("last")).where("last > f.node")
    return first.select(*keys, F.col("f.node").alias("first"), F.col("f.place").alias("first_place"))


GRAMS = pa.schema([(n, pa.int64()) for n in ("gram", "node", "start")] + [("open", pa.bool_())])
_ODD = 0x9E3779B97F4A7C15


def grams(docs: DataFrame, at: DataFrame, spans: DataFrame) -> DataFrame:
    """A hash of each run of ``LEAST`` shingles under the windows (node, place) and over their nodes;
    open: whether no passage of ``spans`` holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            nodes, places, spans = (b.column(i).to_pylist() for i in (0, 2, 3))
            for begin, end in _portions(pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist()):
                shingles = _shingles([t or "" for t in b.column(1).slice(begin, end - begin).to_pylist()])
                longest = max(map(len, shingles))
                power, back = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(longest, x, np.uint64)])) for x in (_ODD, pow(_ODD, -1, 1 << 64)))
                out: list[tuple[np.ndarray, ...]] = []
                for i, s in enumerate(shingles, begin):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(s * power[: len(s)])])
                    first, node, last = unpack(np.array(places[i], np.int64))
                    low = np.maximum(first, node - LEAST + 1)
                    size = np.maximum(np.minimum(node, last - LEAST + 1) + 1 - low, 0)
                    start = np.unique(np.repeat(low - np.cumsum(size) + size, size) + np.arange(int(size.sum())))
                    start = start[start + LEAST <= len(s)]
                    gram = S.mix((total[start + LEAST] - total[start]) * back[start])
                    open_ = np.ones(len(start), bool)
                    for x in spans[i] or ():
                        open_ &= (start < x["start"]) | (start + WORDS > x["end"])
                    out.append((gram.view(np.int64), np.full(len(start), nodes[i]), start, open_))
                yield to_arrow(GRAMS, **{n: np.concatenate([o[j] for o in out]) for j, n in enumerate(GRAMS.names)})

    places = at.groupBy("node").agg(F.collect_set("place").alias("places")).join(spans, "node", "left")
    asked = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(places, "node").select("node", "text", "places", "spans")
    return asked.mapInArrow(run, "gram long, node long, start long, open boolean")


def _exact(docs: DataFrame, known: DataFrame, found: DataFrame) -> DataFrame:
    """(node, first, x, y) of runs of ``LEAST`` equal shingles that no passage holds: each with the
    first document that has it.

    Such a run lies under one window of the first function, with equal min-hashes in all documents,
    and two of the anchors that follow each other are inside it.
    """
    spans = cut(found.groupBy("node").agg(F.collect_set(F.struct("start", "end")).alias("spans")))
    node = F.shiftright("place", 32)
    begin = F.greatest(node - F.shiftright("place", 16).bitwiseAND(F.lit(_SIDE)), node - (LEAST - 1))
    end = F.least(node + F.col("place").bitwiseAND(F.lit(_SIDE)), node + (LEAST - 1)) + S.WIDTH
    side = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.shiftrightunsigned("around", 16 * j).bitwiseAND(F.lit((1 << 32) - 1)).alias("marks")) for j in range(len(ANCHORS) - 1)]))
    # Held by a passage: of those that begin no later, one ends no earlier (one pass over a document's windows and passages).
    so_far = Window.partitionBy("node").orderBy("pos", F.col("upto").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = known.where(F.col("key").bitwiseAND(F.lit(3)) == 0).select("key", "node", "place", "around", "first", begin.alias("pos"), end.alias("ends"))
    passed = found.select("node", F.col("start").alias("pos"), F.col("end").alias("upto")).distinct()
    one = one.unionByName(passed, allowMissingColumns=True).withColumn("held", F.coalesce(F.max("upto").over(so_far) >= F.col("ends"), F.lit(False))).where("key is not null")
    one = one.select("key", "node", "place", ((F.col("node") != F.col("first")) & ~F.col("held")).alias("open"), side.alias("s")).select("key", "node", "place", "open", "s.j", "s.marks")
    one = cut(one.where((F.col("marks").bitwiseAND(F.lit(_SIDE)) > 0) & (F.col("marks") > _SIDE)))
    alike = one.groupBy("key", "j", "marks").agg(F.min("node").alias("x"), F.max("node").alias("y"), F.max("open").alias("o")).where("x < y and o")
    g = cut(grams(docs, one.join(alike, ["key", "j", "marks"]).select("node", "place").distinct(), spans))
    first = g.groupBy("gram").agg(F.min(F.struct("node", "start")).alias("f"), F.max("node").alias("last")).where("last > f.node")
    met = g.where("open").join(first.select("gram", F.col("f.node").alias("first"), F.col("f.start").alias("y")), "gram").where("node <> first")
    # One of each diagonal, which is aligned whole.
    hits = met.groupBy("node", "first", (F.col("start") - F.col("y")).alias("d")).agg(F.min("start").alias("x"))
    return hits.groupBy("node", "first").agg(F.collect_list("x").alias("x"), F.collect_list(F.col("x") - F.col("d")).alias("y"))


def _more(found: DataFrame, others: DataFrame) -> DataFrame:
    """``found`` with the passages of ``others`` that none of the same pair holds."""
    new, old = others.where("start is not null").alias("n"), found.alias("o")
    inside = F.expr("n.node = o.node and n.first = o.first and o.start <= n.start and n.end <= o.end")
    return cut(found.unionByName(new.join(old, inside, "left_anti")))


def _nodes(docs: DataFrame, name: str) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` with a number per document as column ``name``: its doc_id, and above all doc_ids a number
    for each further text of a doc_id. Those, with their doc_id, are the second frame (None: there are none)."""
    own = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_h")).where("_id is not null")
    several = own.groupBy("_id").agg(F.min("_h").alias("_least"), F.max("_h").alias("_most")).where("_least <> _most")
    if not several.limit(1).count():
        return docs.withColumn(name, F.col("doc_id").cast("long")), None
    top = own.agg(F.max("_id")).first()[0]
    others = own.join(several, "_id").where("_h <> _least").select("_id", "_h").distinct()
    others = cut(others.withColumn("_n", F.monotonically_increasing_id() + F.lit(top + 1)))
    same = (docs["doc_id"] == others["_id"]) & (F.xxhash64(docs["text"]) == others["_h"])
    numbered = docs.join(others, same, "left").select(*[docs[c] for c in docs.columns], F.coalesce(others["_n"], docs["doc_id"].cast("long")).alias(name))
    return numbered, others.select(F.col("_n").alias("_node"), "_id")


def passages(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, first_id, first_start, first_end, n_words of every passage that an earlier document holds."""
    numbered, others = _nodes(docs.select("doc_id", "text"), "node")
    found = _passages(numbered.select(F.col("node").alias("doc_id"), "text"))
    if others is not None:
        for c in ("doc_id", "first_id"):
            found = found.join(others, found[c] == others["_node"], "left").withColumn(c, F.coalesce("_id", c)).drop("_node", "_id")
    return found


def _passages(docs: DataFrame) -> DataFrame:
    """The same for documents with one text per doc_id."""
    # Most min-hashes occur once: of those that meet, each window with the first document's.
    alike = Window.partitionBy("key")
    met = windows(docs).select("*", F.min(F.struct("node", "place")).over(alike).alias("f"), F.max("node").over(alike).alias("last")).where("last > f.node")
    known = cut(met.select("key", "node", "place", "around", F.col("f.node").alias("first"), F.col("f.place").alias("first_place")))
    hits = known.where("node <> first")
    pairs = cut(_pairs(hits, ENOUGH))
    found = cut(_verify(docs, pairs).where("start is not null"))
    # Windows that no passage of their pair holds: among those alike in their surroundings.
    side = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.shiftrightunsigned("around", 16 * j).bitwiseAND(F.lit(_SIDE)).alias("mark")) for j in range(len(ANCHORS))]))
    at = F.shiftright("place", 32)
    spans = found.select("node", "first", F.col("start").alias("pos"), (F.col("end") - S.WIDTH).alias("upto"))
    # (one pass over a pair's hits and passages by place: as many rows as the two documents have)
    so_far = Window.partitionBy("node", "first").orderBy("pos", F.col("upto").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = hits.withColumn("pos", at).unionByName(spans, allowMissingColumns=True).withColumn("held", F.max("upto").over(so_far))
    open_ = placed.where(F.col("key").isNotNull() & (F.col("held").isNull() | (F.col("held") < F.col("pos"))))
    left = open_.select("key", "node", "place", side.alias("s")).select("key", "node", "place", "s.j", "s.mark").where("mark > 0")
    again = left.join(_star(left, "key", "j", "mark"), ["key", "j", "mark"]).where("node <> first").select("key", "node", "first", "place", "first_place", (at - F.shiftright("first_place", 32)).alias("d"))
    done = pairs.select("node", "first", F.explode(F.zip_with("x", "y", lambda x, y: x - y)).alias("d")).distinct()
    again = cut(_pairs(again.join(done, ["node", "first", "d"], "left_anti"), 1))
    if again.limit(1).count():
        found = _more(found, _verify(docs, again))
    # Exact passages that are still not held, by all their words.
    rest = cut(_exact(docs, known, found))
    if rest.limit(1).count():
        found = _more(found, _verify(docs, rest, LEAST))
    kept = found.distinct()
    return kept.select(F.col("node").alias("doc_id"), "start", "end", F.col("first").alias("first_id"), "first_start", "first_end", (F.col("end") - F.col("start")).alias("n_words"))


def without(text: str | None, spans: list[tuple[int, int]] | None) -> str | None:
    """The text without the words of the spans; what stands between the others stays."""
    if not text or not spans:
        return text
    _, starts, ends, raw = S.spans(text)
    out, at = [], 0
    for s, e in sorted(spans):
        begin, end = int(starts[s]), int(starts[e]) if e < len(starts) else int(ends[-1])
        if begin > at:
            out.append(raw[at:begin])
        at = max(at, end)
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """All rows and columns; in ``text``, passages that an earlier document holds are cut out."""
    columns, at = docs.columns, docs.columns.index("text")
    node, own = fresh(docs, "_node"), fresh(docs, "_spans")
    numbered, _ = _nodes(docs, node)
    found = _passages(numbered.select(F.col(node).alias("doc_id"), "text"))
    spans = found.groupBy(F.col("doc_id").alias(node)).agg(F.collect_set(F.struct("start", "end")).alias(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            spans = [s and [(x["start"], x["end"]) for x in s] for s in b.column(len(columns)).to_pylist()]
            texts = [without(t, s) for t, s in zip(b.column(at).to_pylist(), spans, strict=True)]
            arrays = [pa.array(texts, b.schema.field(at).type) if i == at else b.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema([b.schema.field(i) for i in range(len(columns))]))

    return numbered.join(spans, node, "left").select(*columns, own).mapInArrow(run, docs.schema)
