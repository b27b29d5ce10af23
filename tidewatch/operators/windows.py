"""Densest sliding window per group (W-1) and rows inside it (J-3).

Semantics: for each group, the largest number of events in any closed time
span of width ``W`` (``end - start <= W``); among equally dense spans the one
that ends first; ``start`` is the first event in ``[end - W, end]``. Events
with a null timestamp are ignored.

Plan shape, chosen for very large and skewed inputs:

* Spark's sliding ``RANGE`` frames recompute the aggregate over the whole frame
  buffer each time the frame moves (O(n*k) for k rows in a window), which a
  single flooding source would make quadratic. Instead every row is paired
  with a *probe* at ``ts - W`` and both are ranked by one incremental running
  count (``UNBOUNDED PRECEDING``), so ``count = cum(ts) - cum(< ts - W)``; the
  window start is the first real event at or after the probe, taken by a
  running minimum in descending order. Both frames are O(1) per row.
* Rows are partitioned by ``(group, time bucket)`` instead of the group alone,
  so a source holding a third of all rows is still spread over many tasks.
  The last ``W`` of each bucket is copied into the next bucket as context
  (a fraction ``W / bucket`` of rows is duplicated), which makes every
  bucket self-sufficient.
* A row is shuffled to its ``(group, time bucket)`` as it is; its probe is made
  there, and buckets with fewer rows than a caller asks for are left out first.
* The pairing of a row with its probe is an aggregate on
  ``(group, bucket, ts)``; the window's hash partitioning already satisfies
  it, so it adds no exchange. The per-group maximum is an ordinary partial +
  final aggregate of a struct.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timecols import epoch_us, from_epoch_us

MINUTE_US = 60_000_000
DEFAULT_BUCKET_MINUTES = 60


def _bucket_us(width_us: int, bucket_minutes: int | None) -> int:
    b = (bucket_minutes or DEFAULT_BUCKET_MINUTES) * MINUTE_US
    return max(b, width_us)


def bucket_of(us: Column, b_us: int) -> Column:
    """Exact integer floor(us / b_us), also for negative values."""
    return ((us - F.pmod(us, F.lit(b_us))) / F.lit(b_us)).cast("long")


def densest_window(df: DataFrame, keys: Sequence[str], ts_col: str, width_minutes: float,
                   bucket_minutes: int | None = None, width_of: Column | None = None,
                   least_of: Column | None = None) -> DataFrame:
    """One row per group: ``keys..., window_count, window_start, window_end``.

    ``window_start``/``window_end`` are TIMESTAMP_NTZ. Groups may differ in width: ``width_of`` gives
    a group's width in minutes from its keys, ``width_minutes`` is then the largest. ``least_of``
    gives a number of rows from its keys: buckets with fewer rows are left out, so that a group
    whose densest window has fewer may lack or give a smaller one.
    """
    keys = list(keys)
    b_us = _bucket_us(int(width_minutes * MINUTE_US), bucket_minutes)
    width = F.lit(int(width_minutes * MINUTE_US)) if width_of is None else (width_of * MINUTE_US).cast("long")

    # events of one instant are counted first (map-side), so a flood is as many rows as it has instants
    base = (df.where(F.col(ts_col).isNotNull())
              .groupBy(*keys, epoch_us(ts_col).alias("t")).agg(F.count(F.lit(1)).alias("n")))
    bucket = bucket_of(F.col("t"), b_us)
    # own row and (near the end of a bucket) a context copy for the next bucket
    near_end = F.col("t") >= (bucket + 1) * F.lit(b_us) - width
    at = F.when(near_end, F.array(F.struct(bucket.alias("b"), F.lit(0).alias("kind")), F.struct((bucket + 1).alias("b"), F.lit(1).alias("kind")))) \
          .otherwise(F.array(F.struct(bucket.alias("b"), F.lit(0).alias("kind"))))
    part = [*keys, "b"]
    dealt = base.select(*keys, "t", "n", F.inline(at)).repartition(*part)
    if least_of is not None:    # all rows of a window lie in the part of its end
        dealt = dealt.withColumn("most", F.sum("n").over(Window.partitionBy(*part))).where(F.col("most") >= least_of).drop("most")
    # the own row's probe is made where it is used
    own = F.struct(F.col("t").alias("pos"), F.col("kind").alias("kind2"))
    probe = F.struct((F.col("t") - width).alias("pos"), F.lit(-1).alias("kind2"))
    rows = (dealt.select(*part, "n", F.col("t").alias("t_end"), F.inline(F.when(F.col("kind") == 0, F.array(own, probe)).otherwise(F.array(own))))
                 .withColumnRenamed("kind2", "kind")
                 .withColumn("real", F.when(F.col("kind") >= 0, F.col("n")).otherwise(F.lit(0))))

    # probes sort before real rows at the same position: (pos, real)
    w_cum = (Window.partitionBy(*part).orderBy("pos", F.col("kind") >= 0)
             .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    w_next = (Window.partitionBy(*part).orderBy(F.col("pos").desc(), (F.col("kind") >= 0).desc())
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = (rows.withColumn("cum", F.sum("real").over(w_cum))
                  .withColumn("nxt", F.min(F.when(F.col("kind") >= 0, F.col("pos"))).over(w_next)))

    paired = (ranked.where(F.col("kind") <= 0)
              .groupBy(*part, "t_end")
              .agg(F.max(F.when(F.col("kind") == 0, F.col("cum"))).alias("cum_le"),
                   F.max(F.when(F.col("kind") == -1, F.col("cum"))).alias("cum_lt"),
                   F.max(F.when(F.col("kind") == -1, F.col("nxt"))).alias("start_us")))
    per_end = paired.select(*keys, (F.col("cum_le") - F.col("cum_lt")).alias("n"),
                            F.col("t_end"), F.col("start_us"))

    best = (per_end.groupBy(*keys)
            .agg(F.max(F.struct(F.col("n"), (-F.col("t_end")).alias("neg_end"), F.col("start_us"))).alias("m")))
    return best.select(*keys,
                       F.col("m.n").cast("long").alias("window_count"),
                       from_epoch_us(F.col("m.start_us")).alias("window_start"),
                       from_epoch_us(-F.col("m.neg_end")).alias("window_end"))


def rows_in_window(df: DataFrame, windows: DataFrame, keys: Sequence[str], ts_col: str,
                   width_minutes: float, bucket_minutes: int | None = None) -> DataFrame:
    """Rows of ``df`` whose group has a window in ``windows`` and whose timestamp
    lies in ``[window_start, window_end]`` (inclusive).

    The join is an equi-join on ``(keys, time bucket)`` plus a range residual:
    a window spans at most two buckets, so the windows side is expanded to
    those buckets and a hot group is matched bucket by bucket. AQE turns it
    into a broadcast join when the (usually pre-filtered) windows side is
    small at run time.
    """
    keys = list(keys)
    width_us = int(width_minutes * MINUTE_US)
    b_us = _bucket_us(width_us, bucket_minutes)
    ev = (df.where(F.col(ts_col).isNotNull())
            .withColumn("_ts_us", epoch_us(ts_col))
            .withColumn("_bucket", bucket_of(F.col("_ts_us"), b_us)))
    # both sides may stem from one frame: the window side gets names of its own
    win = (windows.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)],
                          F.col("window_start").alias("_start"), F.col("window_end").alias("_end"),
                          epoch_us("window_start").alias("_ws"), epoch_us("window_end").alias("_we"))
                  .withColumn("_at", F.explode(F.sequence(bucket_of(F.col("_ws"), b_us), bucket_of(F.col("_we"), b_us)))))
    cond = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)] + [
        F.col("_bucket") == F.col("_at"), F.col("_ts_us") >= F.col("_ws"), F.col("_ts_us") <= F.col("_we")]
    out = ev.join(win, cond, "inner")
    return out.select(*df.columns, F.col("_start").alias("window_start"), F.col("_end").alias("window_end"))
