"""Exact top-k inner products by distributed histogram selection.

Every candidate is scored against every query, block against block. A level
counts scores by bin (score >> shift) and narrows each query to the bin that
holds its kth score; after the last level (shift 0) that score is known
exactly. A block only reports bins at or above its own kth best: the global
kth score can't be lower, so no count is lost and a block reports at most k
bins a query. The last pass keeps scores above the kth, and of ties the k
smallest ids of each block; they are then ranked.

Both sides are cut into blocks of fixed size, and ``TILE`` blocks of either side
to a tile; tiles meet by a merge join on the pair of tiles, which spills, and a
row of the join is one pair of blocks. The number of tiles grows with both sides,
so more rows are more keys and no task holds more than one pair at a time.

Vectors that are null or hold a null or non-finite component take no part;
vectors of different lengths are not compared. Rows with the query's own id
are no candidates of it; of several rows with a query's id the smallest
vector is the query. Repeated candidate rows each count. Fewer than k
candidates: all. Extra columns are ignored; an empty table gives no rows. Where a
product may not fit in 64 bits the call fails.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices, to_arrow

QUERIES, CANDIDATES = 1024, 4096
#: Blocks of a side that meet the other side's together.
TILE = 8
#: Tiles of candidates at least, for as many tasks.
SPREAD = 48
LEVELS = 3


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, v array<long>: floor(256 * x) of the usable vectors."""
    fine = F.forall("embedding", lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine & (F.size("embedding") > 0)).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("v"),
    )


def _candidates(vectors: DataFrame, tiles: int) -> DataFrame:
    """Blocks of vectors as they lie in their partitions, and the tile ``to`` of each."""
    schema = pa.schema([("dim", pa.int32()), ("to", pa.int32()), ("ids", pa.binary()), ("values", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = TaskContext.get().partitionId()
        for b in slices(batches, CANDIDATES):
            lists, ids = b.column(1), b.column(0).to_numpy(zero_copy_only=False)
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat, ends = lists.flatten().to_numpy(), np.cumsum(size)
            for dim in np.unique(size).tolist():
                rows = np.flatnonzero(size == dim)
                values = flat if len(rows) == len(size) else np.concatenate([flat[ends[r] - dim : ends[r]] for r in rows])
                k += 1
                yield to_arrow(schema, dim=[dim], to=[k % tiles], ids=[ids[rows].astype("<i8").tobytes()], values=[values.astype("<i8").tobytes()])

    return quantised(vectors).mapInArrow(run, "dim int, to int, ids binary, values binary")


def _queries(queries: DataFrame, blocks: int, tiles: int) -> DataFrame:
    """Blocks of queries with their state and their tile ``own``, one copy per tile of candidates."""
    q = queries.groupBy(F.size("v").alias("dim"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("query_id", "v", "bin", "need")).alias("q"))
    own = F.floor(F.col("block") / TILE).cast("int").alias("own")
    return q.select("dim", own, F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("to"), F.col("q.query_id").alias("q_ids"), F.flatten("q.v").alias("q_values"), F.col("q.bin").alias("q_bins"), F.col("q.need").alias("q_need"))


def pairs(candidates: DataFrame, queries: DataFrame, blocks: int) -> DataFrame:
    """A row per pair of a block of candidates and a block of queries."""
    tiles = F.explode(F.sequence(F.lit(0), F.lit(-(-blocks // TILE) - 1)))
    joined = candidates.withColumn("own", tiles).join(queries.hint("merge"), ["dim", "own", "to"])
    return joined.select("dim", "ids", "values", "q_ids", "q_values", "q_bins", "q_need")


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products; in floating point while that is exact."""
    if float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < 2**53:
        return (q.astype(float) @ c.astype(float).T).astype(np.int64)
    return q @ c.T


def _pass(joined: DataFrame, shift: int, before: int | None, last: bool = False) -> DataFrame:
    """One scoring of all pairs: (query_id, key, n) as bins and counts, or at last as ids and scores."""
    schema = pa.schema([("query_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64())])

    def bins(s: np.ndarray, ids: np.ndarray, bin_: int | None, need: int) -> tuple[np.ndarray, np.ndarray]:
        if before is not None:
            s = s[s >> before == bin_]
        if len(s) > need:
            least = np.partition(s, len(s) - need)[len(s) - need]
            s = s[s >= least >> shift << shift]
        return np.unique(s >> shift, return_counts=True)

    def best(s: np.ndarray, ids: np.ndarray, kth: int | None, need: int) -> tuple[np.ndarray, np.ndarray]:
        if kth is None:
            return ids, s
        ties = np.sort(ids[s == kth])[:need]
        over = s > kth
        return np.concatenate([ids[over], ties]), np.concatenate([s[over], np.full(len(ties), kth)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            r = {n: b.column(i)[0] for i, n in enumerate(b.schema.names)}
            dim, ids = r["dim"].as_py(), np.frombuffer(r["ids"].as_py(), "<i8")
            own, state, need = (r[n].as_py() for n in ("q_ids", "q_bins", "q_need"))
            table = scores(r["q_values"].values.to_numpy().reshape(-1, dim), np.frombuffer(r["values"].as_py(), "<i8").reshape(-1, dim))
            out = []
            for query, s, at, n in zip(own, table, state, need, strict=True):
                other = ids != query
                key, count = (best if last else bins)(s[other], ids[other], at, n)
                out.append((np.full(len(key), query), key, count))
            if out:
                yield to_arrow(schema, **dict(zip(schema.names, map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return joined.mapInArrow(run, "query_id long, key long, n long")


def top_k(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of every query."""
    v = quantised(vectors)
    q = v.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    bound = v.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))).alias("most")).first()
    blocks = -(-q.count() // QUERIES) or 1
    bits = max(1, ((bound.dim or 0) * (bound.most or 0) ** 2).bit_length())
    if bits > 63:
        raise ValueError(f"inner products may take {bits} bits and a sign; 64 bits hold them up to 63")
    tiles = max(SPREAD, -(-bound.n // (TILE * CANDIDATES)))
    shifts = [bits * (LEVELS - 1 - i) // LEVELS for i in range(LEVELS)]
    candidates = _candidates(vectors, tiles)
    state = q.select("query_id", F.lit(None).cast("long").alias("bin"), F.lit(k).alias("need"))
    met = lambda: pairs(candidates, _queries(q.join(state, "query_id"), blocks, tiles), blocks)  # noqa: E731  with the state of now
    before = None
    for shift in shifts:
        counted = _pass(met(), shift, before).groupBy("query_id", "key").agg(F.sum("n").alias("n"))
        w = Window.partitionBy("query_id").orderBy(F.desc("key"))
        # The bin that holds the kth score; one that has fewer candidates than k narrows to its last bin.
        reached = counted.select("query_id", "key", "n", F.sum("n").over(w).alias("upto")).join(state.select("query_id", F.col("need").alias("need")), "query_id")
        at = reached.groupBy("query_id").agg(F.max(F.when(F.col("upto") >= F.col("need"), F.struct("key", (F.col("need") - F.col("upto") + F.col("n")).alias("need")))).alias("at"), F.min(F.struct("key", F.col("n").alias("need"))).alias("last"))
        state = cut(at.select("query_id", F.coalesce("at", "last")["key"].alias("bin"), F.coalesce("at", "last")["need"].cast("int").alias("need")))
        before = shift
    found = _pass(met(), 0, None, last=True)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "key"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("key").alias("vec_id"), F.col("n").alias("score"))


SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
a as (select vec_id, unnest(v) as x, generate_subscripts(v, 1) as i from v),
s as (select q.vec_id as query_id, c.vec_id as vec_id, sum(q.x * c.x)::bigint as score from a q join a c on q.i = c.i and q.vec_id <> c.vec_id
      where q.vec_id % 50 = 0 group by 1, 2),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
