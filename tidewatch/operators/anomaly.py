"""Behavioural anomaly model per source IP (A-1 .. A-6).

* :func:`ip_features` - eight behaviour features per IP (A-1), from a state that
  merges over days (:func:`ip_state`, :func:`merge_ip_states`).
* :func:`standardize` - population z-scores; the 16 moments are a one-row
  aggregate read back as literals, like a fitted scaler (A-2).
* :func:`isolation_forest_scores` - isolation forest (Liu, Ting, Zhou 2008):
  200 trees, each fitted on psi = min(256, n) IPs chosen by a seeded hash
  rank. Sampling is a filter on the hash, fitting is one ``applyInPandas``
  task per tree (bounded: about 4*psi rows), and the fitted forest (at most
  200 * (2*psi - 1) nodes, a proven bound) is broadcast to an Arrow
  ``mapInPandas`` scorer. Scores are min-max normalised over all IPs (A-3, A-4).
* :func:`top_features` - the three features with the largest |z| (A-5).
* :func:`unknown_anomalies` - anomalous IPs that no rule flagged (A-6).
* :func:`zscore_scores` - a deterministic, SQL-expressible score (mean |z|,
  min-max normalised) used where a query must be checked against SQL.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numfmt import rnd
from ..session import cut_lineage
from .detect import DETECTOR_ORDER, evidence

# ---- fixed values ----------------------------------------------------------
FEATURE_NAMES = [
    "event_count", "failed_ratio", "distinct_ports", "distinct_destinations",
    "distinct_paths", "distinct_usernames", "avg_payload_size", "off_hours_ratio",
]
N_TREES = 200
MAX_SAMPLES = 256
MIN_IPS = 8
UNKNOWN_ANOMALY_THRESHOLD = 0.7
SEED = 42
UNKNOWN_NOTE = "Behaviour differs from baseline but did not match a known attack signature."
# ------------------------------------------------------------------------------
_EULER = 0.5772156649015329


#: The columns whose distinct values a source is measured by, and the feature of each.
DISTINCT = {"port": "distinct_ports", "destination_ip": "distinct_destinations", "request_path": "distinct_paths",
            "username": "distinct_usernames"}
_SUMS = ["n", "failed", "payload", "off_hours"]


def ip_state(df: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """A-1 as a state that merges: states of parts (days) together give the state of the whole.

    Exact: a row per (source_ip, kind, value) - kind -1 holds the sums and the first and last
    timestamp, kinds 0.. one distinct value of a column each. A row of the log becomes at most five,
    which are summed map-side, so a hot source is as many rows as it has distinct values.
    ``approx_distinct``: a row per source with the sums and a HyperLogLog sketch per column.
    """
    hour = F.hour("timestamp")
    scoped = df.where(F.col("source_ip").isNotNull())
    sums = [F.lit(1).cast("long").alias("n"), F.least(F.coalesce("failed_attempts", F.lit(0.0)), F.lit(1.0)).alias("failed"),
            F.coalesce("payload_size", F.lit(0.0)).alias("payload"), F.when((hour < 6) | (hour >= 22), 1.0).otherwise(0.0).alias("off_hours"),
            F.col("timestamp").alias("first_ts"), F.col("timestamp").alias("last_ts")]
    if approx_distinct:
        rows = scoped.select("source_ip", *sums, *[F.col(c).cast("string").alias(c) for c in DISTINCT])
        return rows.groupBy("source_ip").agg(*_merged_sums(), *[F.hll_sketch_agg(c).alias(c) for c in DISTINCT])
    nothing = [F.lit(0).cast("long").alias("n"), *[F.lit(0.0).alias(c) for c in _SUMS[1:]],
               *[F.lit(None).cast(df.schema["timestamp"].dataType).alias(c) for c in ("first_ts", "last_ts")]]
    whole = F.struct(F.lit(-1).alias("kind"), F.lit(None).cast("string").alias("value"), *sums)
    each = [F.when(F.col(c).isNotNull(), F.struct(F.lit(i).alias("kind"), F.col(c).cast("string").alias("value"), *nothing))
            for i, c in enumerate(DISTINCT)]
    rows = scoped.select("source_ip", F.inline(F.array_compact(F.array(whole, *each))))
    return rows.groupBy("source_ip", "kind", "value").agg(*_merged_sums())


def _merged_sums() -> list[Column]:
    return [*[F.sum(c).alias(c) for c in _SUMS], F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")]


def merge_ip_states(states: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """One state from the rows of several (their union)."""
    if approx_distinct:
        return states.groupBy("source_ip").agg(*_merged_sums(), *[F.hll_union_agg(c).alias(c) for c in DISTINCT])
    return states.groupBy("source_ip", "kind", "value").agg(*_merged_sums())


def profile_of(state: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """The eight features and each source's first and last timestamp, from a state."""
    if approx_distinct:
        distinct = {f: F.coalesce(F.hll_sketch_estimate(c), F.lit(0)) for c, f in DISTINCT.items()}
        whole = state
    else:
        counts = {f: F.count_if(F.col("kind") == i).alias(f) for i, f in enumerate(DISTINCT.values())}
        whole = state.groupBy("source_ip").agg(*_merged_sums(), *counts.values())
        distinct = {f: F.col(f) for f in counts}
    share = lambda c: F.col(c) / F.col("n")
    return whole.select("source_ip", F.col("n").cast("double").alias("event_count"), share("failed").alias("failed_ratio"),
                        *[c.cast("double").alias(f) for f, c in distinct.items()], share("payload").alias("avg_payload_size"),
                        share("off_hours").alias("off_hours_ratio"), "first_ts", "last_ts")


def ip_features(df: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """A-1: the eight features of every source. ``approx_distinct`` counts distinct values by
    HyperLogLog sketches, one row per source map-side (relative error about 2%)."""
    return ip_profile(df, approx_distinct).drop("first_ts", "last_ts")


def ip_profile(df: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """The features and, from the same aggregate, each IP's first and last timestamp."""
    return profile_of(ip_state(df, approx_distinct), approx_distinct)


def _moments(feats: DataFrame) -> dict[str, tuple[float, float]]:
    aggs = []
    for f in FEATURE_NAMES:
        aggs += [F.avg(f).alias(f"mu_{f}"), F.stddev_pop(f).alias(f"sd_{f}")]
    row = feats.agg(*aggs).collect()[0]
    out = {}
    for f in FEATURE_NAMES:
        sd = row[f"sd_{f}"]
        out[f] = (row[f"mu_{f}"] or 0.0, 1.0 if not sd else sd)
    return out


def standardize(feats: DataFrame, digits: int | None = None) -> DataFrame:
    """Add ``z_<feature>`` columns: (x - mean) / (population std, 0 -> 1)."""
    m = _moments(feats)
    cols = []
    for f in FEATURE_NAMES:
        mu, sd = m[f]
        z = (F.coalesce(F.col(f), F.lit(0.0)) - F.lit(mu)) / F.lit(sd)
        cols.append((rnd(z, digits) if digits is not None else z).alias(f"z_{f}"))
    return feats.select("*", *cols)


def top_features(z: DataFrame, k: int = 3) -> DataFrame:
    """``top_features ARRAY<STRUCT<feature, value>>``: largest |z| first, ties by feature order."""
    entries = F.array(*[F.struct(rnd(-F.abs(F.col(f"z_{f}")), 6).alias("k"), F.lit(i).alias("i"),
                                 F.lit(f).alias("feature"), rnd(F.col(f), 2).alias("value"))
                        for i, f in enumerate(FEATURE_NAMES)])
    top = F.slice(F.array_sort(entries), 1, k)
    return z.withColumn("top_features", F.transform(top, lambda e: F.struct(
        e["feature"].alias("feature"), e["value"].alias("value"))))


# ---------------------------------------------------------------- forest
def _c(n):
    """Average path length of an unsuccessful BST search among n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + _EULER) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _fit_tree(pdf: pd.DataFrame, psi: int, height: int) -> pd.DataFrame:
    tree = int(pdf["tree"].iloc[0])
    X = np.asarray(pdf["x"].tolist(), dtype=float)
    rng = np.random.default_rng([SEED, tree])
    feat, thr, left, right, size = [], [], [], [], []

    def node(idx, depth):
        nid = len(feat)
        feat.append(-1); thr.append(0.0); left.append(-1); right.append(-1); size.append(len(idx))
        if depth >= height or len(idx) <= 1:
            return nid
        sub = X[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            return nid
        q = int(rng.choice(usable))
        p = float(rng.uniform(lo[q], hi[q]))
        go_left = sub[:, q] < p
        feat[nid], thr[nid] = q, p
        left[nid] = node(idx[go_left], depth + 1)
        right[nid] = node(idx[~go_left], depth + 1)
        return nid

    node(np.arange(len(X)), 0)
    return pd.DataFrame({"tree": tree, "node": np.arange(len(feat)), "feat": feat, "thr": thr,
                         "left": left, "right": right, "size": size})


def _sample(z: DataFrame, n: int, psi: int, oversample: float) -> DataFrame:
    p = min(1.0, oversample * psi / max(n, 1))
    cut = int((2 ** 63 - 1) * p) if p < 1.0 else None
    h = lambda t: F.abs(F.xxhash64(F.lit(SEED), t, F.col("source_ip")))
    trees = F.sequence(F.lit(0), F.lit(N_TREES - 1))
    if cut is not None:
        trees = F.filter(trees, lambda t: h(t) < F.lit(cut))
    cand = z.select("source_ip", "x", F.explode(trees).alias("tree")).withColumn("h", h(F.col("tree")))
    w = Window.partitionBy("tree").orderBy("h", "source_ip")
    return cand.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= psi).drop("rn", "h")


def isolation_forest_scores(z: DataFrame) -> DataFrame:
    """``source_ip, anomaly_score`` (0-1, 4 digits) from standardised features.

    Fewer than 8 IPs -> every score is 0.
    """
    spark = z.sparkSession
    zc = z.select("source_ip", F.array(*[F.col(f"z_{f}") for f in FEATURE_NAMES]).alias("x"))
    n = zc.count()
    if n < MIN_IPS:
        return zc.select("source_ip", F.lit(0.0).alias("anomaly_score"))
    psi = min(MAX_SAMPLES, n)
    height = int(math.ceil(math.log2(max(psi, 2))))
    # hash-selected candidates per tree, widened until every tree has psi of them (at the widest, all rows)
    spread = 4.0
    while True:
        sample = cut_lineage(_sample(zc, n, psi, spread))
        if spread * psi >= n or sample.groupBy("tree").count().where(F.col("count") >= psi).count() == N_TREES:
            break
        spread *= 4
    schema = "tree int, node long, feat long, thr double, left long, right long, size long"
    nodes = sample.groupBy("tree").applyInPandas(lambda pdf: _fit_tree(pdf, psi, height), schema)
    rows = nodes.orderBy("tree", "node").collect()     # bounded: 200 * (2 * psi - 1) nodes
    width = max(r["node"] for r in rows) + 1
    model = {k: np.full((N_TREES, width), v, dtype=dt) for k, v, dt in
             (("feat", -1, np.int64), ("thr", 0.0, float), ("left", -1, np.int64),
              ("right", -1, np.int64), ("size", 0, np.int64))}
    for r in rows:
        for k in model:
            model[k][r["tree"], r["node"]] = r[k]
    bc = spark.sparkContext.broadcast(model)
    c_psi = float(_c(np.array([psi]))[0])

    def score(batches):
        m = bc.value
        for pdf in batches:
            X = np.asarray(pdf["x"].tolist(), dtype=float).reshape(len(pdf), len(FEATURE_NAMES))
            total = np.zeros(len(X))
            rows_ix = np.arange(len(X))
            for t in range(N_TREES):
                nd = np.zeros(len(X), dtype=np.int64)
                depth = np.zeros(len(X))
                while True:
                    f = m["feat"][t, nd]
                    inner = f >= 0
                    if not inner.any():
                        break
                    go_left = X[rows_ix, np.where(inner, f, 0)] < m["thr"][t, nd]
                    nxt = np.where(go_left, m["left"][t, nd], m["right"][t, nd])
                    nd = np.where(inner, nxt, nd)
                    depth = depth + inner
                total += depth + _c(m["size"][t, nd])
            s = np.power(2.0, -(total / N_TREES) / c_psi)
            yield pd.DataFrame({"source_ip": pdf["source_ip"], "raw": s})

    raw = cut_lineage(zc.mapInPandas(score, "source_ip string, raw double"))   # scored once, read twice
    return minmax(raw, "raw", "anomaly_score")


def minmax(df: DataFrame, col: str, out: str, digits: int = 4, min_rows: int = 0) -> DataFrame:
    """(x - min) / (max - min) over the whole column; all equal (or fewer than
    ``min_rows`` rows) -> 0; rounded. One small aggregate read on the driver."""
    r = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"), F.count(F.lit(1)).alias("n")).collect()[0]
    lo, hi = r["lo"], r["hi"]
    if r["n"] < min_rows or lo is None or hi is None or not hi > lo:
        return df.select("source_ip", F.lit(0.0).alias(out))
    return df.select("source_ip", rnd((F.col(col) - F.lit(lo)) / F.lit(hi - lo), digits).alias(out))


def zscore_scores(z: DataFrame) -> DataFrame:
    """Deterministic score: mean |z| (z rounded to 6 digits), min-max normalised."""
    s = None
    for f in FEATURE_NAMES:
        a = F.abs(rnd(F.col(f"z_{f}"), 6))
        s = a if s is None else s + a
    return minmax(z.select("source_ip", (s / F.lit(float(len(FEATURE_NAMES)))).alias("raw")), "raw",
                  "anomaly_score", min_rows=MIN_IPS)


def score_ips(profile: DataFrame, method: str = "forest") -> DataFrame:
    """``anomaly_score, top_features`` beside the per-IP profile. Fewer than 8 IPs: score 0, no top features."""
    z = standardize(profile)
    scores = isolation_forest_scores(z) if method == "forest" else zscore_scores(z)
    few = F.lit(profile.count() < MIN_IPS)
    none = F.array().cast("array<struct<feature:string,value:double>>")
    top = top_features(z).withColumn("top_features", F.when(few, none).otherwise(F.col("top_features")))
    return top.select(*profile.columns, "top_features").join(scores, "source_ip")


def anomaly_scores(df: DataFrame, method: str = "forest", approx_distinct: bool = False) -> DataFrame:
    """``source_ip, anomaly_score, top_features`` for every IP of the event table."""
    scored = score_ips(cut_lineage(ip_features(df, approx_distinct)), method)
    return scored.select("source_ip", "anomaly_score", "top_features")


def unknown_anomalies(scores: DataFrame, rule_hits: DataFrame) -> DataFrame:
    """Detections for IPs scoring >= 0.7 that no rule flagged. ``scores`` is a scored :func:`ip_profile`."""
    j = (scores.where(F.col("anomaly_score") >= UNKNOWN_ANOMALY_THRESHOLD)
               .join(rule_hits.select("source_ip").distinct(), "source_ip", "left_anti")
               .withColumn("ws", F.col("first_ts")).withColumn("we", F.col("last_ts")).withColumn("n", F.col("event_count")))
    return j.select(
        F.lit("unknown_anomaly").alias("detection_type"),
        F.lit(DETECTOR_ORDER["unknown_anomaly"]).alias("detector_order"),
        "source_ip", F.col("ws").alias("window_start"), F.col("we").alias("window_end"),
        F.col("anomaly_score").cast("double").alias("severity"), F.col("n").cast("long").alias("event_count"),
        F.array().cast("array<string>").alias("targeted_usernames"),
        evidence(anomaly_score=F.col("anomaly_score"), deviating_features=F.col("top_features"),
                 note=F.lit(UNKNOWN_NOTE)).alias("evidence"))
