"""Exact, bounded "first k distinct values per group" without collecting a group.

Used for sample lists (first 10 target hosts / paths in input order). A group
may be huge, so the distinct values are first reduced per (group, value) with a
partial aggregate, then ranked inside ``(group, salt)`` sub-groups, so no task
ever holds more than one salt slice of a group; the final per-group list is
merged from at most ``k * salt`` candidates. The overall first k are always
among the first k of some slice, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SALT = 16


def first_k_distinct(df: DataFrame, keys: Sequence[str], value_col: str, order_col: str, k: int,
                     out_col: str, salt: int = DEFAULT_SALT) -> DataFrame:
    """``keys..., out_col ARRAY`` with the first ``k`` distinct non-null values by ``order_col``."""
    keys = list(keys)
    firsts = (df.where(F.col(value_col).isNotNull())
                .groupBy(*keys, value_col).agg(F.min(order_col).alias("_o")))
    sliced = firsts.withColumn("_s", F.pmod(F.xxhash64(F.col(value_col)), F.lit(salt)))
    w = Window.partitionBy(*keys, "_s").orderBy("_o", value_col)
    cand = sliced.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    merged = cand.groupBy(*keys).agg(
        F.slice(F.array_sort(F.collect_list(F.struct(F.col("_o"), F.col(value_col).alias("v")))), 1, k).alias("_l"))
    return merged.select(*keys, F.transform("_l", lambda x: x["v"]).alias(out_col))


def first_k_rows(df: DataFrame, keys: Sequence[str], order: Sequence, k: int, salt: int = DEFAULT_SALT,
                 rank_col: str = "rank") -> DataFrame:
    """The first ``k`` rows of every group by ``order`` (Column expressions, ties
    must be broken by the caller), numbered 1..k in ``rank_col``.

    Where Spark limits groups before the shuffle (``windowGroupLimitThreshold``), a task sends at most
    ``k`` rows of a group and one rank is enough. For a larger ``k`` two phases: rows are ranked inside
    ``(group, salt)`` slices (salt = hash of the whole row), at most ``k`` survive per slice, and the
    final rank is taken over at most ``k * salt`` survivors per group.
    """
    keys = list(keys)
    if k <= int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        first = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(rank_col, F.row_number().over(first)).where(F.col(rank_col) <= k)
    salted = df.withColumn("_s", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salt)))
    w1 = Window.partitionBy(*keys, "_s").orderBy(*order)
    cand = salted.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= k).drop("_r", "_s")
    w2 = Window.partitionBy(*keys).orderBy(*order)
    return cand.withColumn(rank_col, F.row_number().over(w2)).where(F.col(rank_col) <= k)
